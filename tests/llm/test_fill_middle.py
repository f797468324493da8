import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import fill_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(alphabet="ab \t\n<>PSM\u00e9\u20ac\U0001f600\u00a0\u2003\u0000", max_size=40)


def by_characters(doc_id, text):
    """The contract on code points, without any byte arithmetic."""
    units = UNIT.findall(text)
    code = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[i:i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = parts
    spm = h[3] % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), out


@settings(max_examples=300, deadline=None)
@given(st.integers(-10**6, 10**6), TEXTS)
def test_examples_equal_the_definition_and_are_reversible(doc_id, text):
    n, form, prefix, middle, out = fim.example(doc_id, text.encode())
    assert (n, form, prefix, middle, out.decode()) == by_characters(doc_id, text)
    assert fim.restore(out, form) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_exceptions_translate_every_cut(text):
    index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
    places = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.chars(np.array(places)).tolist() == list(range(len(text) + 1))
    assert index.bytes(np.arange(len(text) + 1)).tolist() == places
    assert len(index.at_byte) == sum(len(c.encode()) > 1 for c in text)


ROWS = [(i, f"Wörter {i} und\tmehr €  \n text " * (i % 7) + "end" * (i % 2)) for i in range(200)]
ODD = [(None, "no identifier at all"), (500, None), (501, ""), (502, "has <M> inside"), (503, " \n "), (504, "x"), (505, "long é " * 60_000), (7, "again"), (7, "again")]


def test_query_equals_sql(spark, documents, sf):
    folder = sf(documents=documents(*ROWS, *ODD))
    got = fim.op11_fill_middle(spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    expected = duck.execute(fim.SQL_TEXT)
    assert got.columns == [c[0] for c in expected.description]
    rows = got.collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected.fetchall()))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    texts = {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS + ODD}
    assert {(r["doc_id"], r["restored_sha256"]) for r in rows} == texts


def test_clashing_and_dotted_columns_are_carried_along(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, "x", 2.5)], "doc_id LONG, text STRING, n LONG, row STRING, `made.up` DOUBLE")
    row = fim.examples(df).first()
    assert row["row"].asDict() == {"doc_id": 1, "text": "a b c d", "n": 5, "row": "x", "made.up": 2.5} and row["n"] == 4


def test_empty_table(spark, documents):
    assert fim.examples(documents((1, "a")).limit(0)).collect() == []
