import random
import re
from collections import Counter

import pytest

from opslens.llm import quality_rules

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated)}


CASES = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 9, "x " * 30 + "y " * 30, "\n\nline\n line\nline\n \nline", "é😀 #|<> 中文\x85x y",
    "a b c d e f g h i a b c d e f g h j " * 2 + "z", "tab\tand\x0bvt\x0cff\rcr\nlf", "word " * 40_000,
]


def test_counts_of_every_kind(documents):
    df = documents(*enumerate(CASES)).selectExpr("doc_id", "text", "source AS t", "source AS w", "source AS h", "n_chars AS n_words")
    got = {r["doc_id"]: r for r in quality_rules.statistics(df).collect()}
    for i, text in enumerate(CASES):
        assert {k: got[i][k] for k in brute(text)} == brute(text), (text or "")[:40]


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = quality_rules.op9_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text):
        counts, row = brute(text), got.loc[i]
        assert {k: row[k] for k in counts} == counts
        failed = counts["n_words"] < 20 or 100 * counts["n_repeat_words"] > 30 * counts["n_words"]
        assert row.base_failed == failed and not (failed and row.kept)


def test_label_model_finds_accuracies(spark):
    """Documents whose votes are drawn with known accuracies."""
    rng = random.Random(11)
    names = list(quality_rules.rules())
    hit = {n: 0.9 + 0.008 * i for i, n in enumerate(names)}
    alarm = {n: 0.3 + 0.05 * i for i, n in enumerate(names)}
    rows = []
    for _ in range(20_000):
        good = rng.random() < 0.8
        rows.append([None if rng.random() < 0.1 else int(rng.random() < (hit[n] if good else 1 - alarm[n])) for n in names])
    voted = spark.createDataFrame(rows, ", ".join(f"vote_{n} INT" for n in names))
    got_hit, got_alarm, good = quality_rules.label_model(voted)
    assert good == pytest.approx(0.8, abs=0.03)
    assert got_hit == pytest.approx(hit, abs=0.03) and got_alarm == pytest.approx(alarm, abs=0.08)


def test_label_model_without_rows(documents):
    empty = documents((1, "x")).where("false")
    assert quality_rules.judged(empty).count() == 0


def test_junk_goes_and_prose_stays(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.judged(documents).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert got[got.quality == 0].kept.mean() < 0.2 and got[got.quality == 1].kept.mean() > 0.97


def test_only_dataframe_functions(spark, capsys):
    quality_rules.op9_quality_rules(spark, SF).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
