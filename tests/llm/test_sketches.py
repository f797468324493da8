import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import sketches

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(texts):
    """Each text with its last third from the next one, in a circle."""
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 3
        out.append(t[:len(t) - k] + texts[(i + 1) % len(texts)][:k])
    return out


@pytest.mark.parametrize("rows", [1024, 16])
def test_query_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(sketches, "RANGE_ROWS", rows)
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ascending=False)
    texts = documents.text.tolist()
    got = sketches.op10_document_sketch(spark, SF).toPandas().set_index("doc_id").loc[documents.doc_id]
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited(texts)]
    near = [jaccard(a, b) for a, b in zip(texts, edited(texts))]
    assert np.abs(got.near_edited - near).mean() < 0.08
    assert np.abs(got.near_next - [jaccard(t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]).mean() < 0.02
    by_text = {}
    for text, mark in zip(texts, got.fingerprint):
        assert by_text.setdefault(text, mark) == mark


def test_rows_of_every_kind(spark, documents, sf):
    folder = sf(documents=documents((5, None), (4, ""), (3, "ab"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (None, "zzz yyy xxx"), (None, "zzz yyy xxx")))
    got = sketches.op10_document_sketch(spark, folder).toPandas()
    assert len(got) == 7 and got.n_chars.tolist().count(0) == 2
    rows = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    assert rows[5].fingerprint == rows[4].fingerprint == "" and rows[5].near_next == 1 and rows[4].near_next == 0
    assert rows[3].near_edited == 1 and rows[3].edited_sha256 == hashlib.sha256(b"ab").hexdigest()  # a third of two is nothing
    # The last row, a null identifier, is followed by the first, whose text is empty.
    assert hashlib.sha256(b"zzz yyy ").hexdigest() in set(got.edited_sha256)


def test_single_row_and_empty_table(spark, documents):
    rows = documents((7, "a b c d e f")).selectExpr("doc_id", "text")
    assert [r["next_text"] for r in sketches.with_next(rows, "doc_id", ["text"]).collect()] == ["a b c d e f"]
    assert sketches.with_next(rows.where("false"), "doc_id", ["text"]).columns == ["doc_id", "text", "next_text"]


def test_containment_between_unequal_documents(spark):
    words = [f"w{i}" for i in range(6000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1600])), (3, " ".join(words[5700:] + [f"v{i}" for i in range(300)]))]
    df = spark.createDataFrame(rows, "id INT, text STRING").withColumn("sketch", sketches.sketch(F.col("text")))
    a, b, c = (r["sketch"] for r in df.orderBy("id").collect())
    assert len(a) == pytest.approx(6000 / 2 ** sketches.SHIFT, rel=0.15)
    pair = lambda x, y: spark.createDataFrame([(x, y)], "x ARRAY<LONG>, y ARRAY<LONG>").select(sketches.containment(F.col("x"), F.col("y"))).first()[0]
    assert pair(b, a) == 1 and pair(a, b) == pytest.approx(0.1, abs=0.03) and pair(c, a) == pytest.approx(0.5, abs=0.15)


def test_containment_of_short_texts_is_never_wrong(spark):
    """Texts of five to nine words inside a long one: held, or undecided where no hash is below the threshold."""
    words = [f"w{i}" for i in range(400)]
    rows = [(" ".join(words[i:i + 5 + i % 5]), " ".join(words)) for i in range(60)]
    df = spark.createDataFrame([*rows, (rows[0][0], ""), ("", rows[0][0])], "a STRING, b STRING")
    got = [r[0] for r in df.select(sketches.containment(sketches.sketch(F.col("a")), sketches.sketch(F.col("b")))).collect()]
    assert set(got[:60]) == {1.0, None} and got[60:] == [0.0, 0.0]


def test_sketch_of_a_union_is_the_union(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(k, k + 400))) for k in (0, 200, 300)] + [(2, "tiny")], "g INT, text STRING").withColumn("sketch", sketches.sketch(F.col("text")))
    whole = spark.createDataFrame([(" ".join(f"w{i}" for i in range(700)),)], "text STRING").select(sketches.sketch(F.col("text"))).first()[0]
    got = {r["hash"] for r in sketches.merged(df, "g").where("g = 1").collect()}
    assert got == set(whole)


def test_only_dataframe_functions(spark, capsys):
    sketches.op10_document_sketch(spark, SF).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
