import math

import pytest
from pyspark.sql import functions as F

from opslens.llm import quality_classifier as qc
from opslens.llm._common import held_out

SF = "/root/testdata/sf0.01"
FOREST = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 0.25)
      Predict: 0.0
     Else (feature 1 > 0.25)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 3.0)
      Predict: 1.0
     Else (feature 0 > 3.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""


def test_paths():
    got = {r.parts for r in qc.paths(FOREST, ["a", "b"])}
    assert got == {(("a", True, 1.5),), (("a", True, 1.5), ("b", True, 0.25)), (("a", True, 1.5), ("b", False, 0.25)), (("a", False, 1.5),), (("a", False, 1.5), ("a", True, 3.0)), (("a", False, 3.0),)}


def test_compiled_score(spark):
    rules = ((2.0, qc.Rule((("a", True, 1.5),))), (-3.0, qc.Rule((("a", False, 0.5), ("b", True, 0.2)))))
    df = spark.createDataFrame([(1.0, 0.1), (1.0, 0.3), (2.0, 0.1), (2.0, 0.9)], "a DOUBLE, b DOUBLE")
    got = [r[0] for r in df.select(qc.Ensemble(0.5, rules).score()).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-z)) for z in (-0.5, 2.5, -2.5, 0.5)])


def test_held_out_accuracy(spark):
    got = qc.op1_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert sum((g > bad).sum() for g in good) / (len(good) * len(bad)) > 0.97


def test_held_out_labels_are_not_learned_from(spark):
    stats = qc.saved(qc.measured(spark.read.parquet(f"{SF}/documents.parquet")), "m")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (qc.fit(stats, x) for x in (labels, flipped))
    assert [r for _, r in one.rules] == [r for _, r in two.rules] and one.intercept == pytest.approx(two.intercept, abs=1e-6)


def test_repeated_rows_are_learned_from_once(spark, documents):
    """Three documents of one label and a thousand rows of one of the other: each counts once."""
    ids = [r["doc_id"] for r in spark.range(20).selectExpr("id AS doc_id").where(~held_out(F.col("doc_id"))).limit(4).collect()]
    labels = spark.createDataFrame([(i, int(i != ids[0]), 0) for i in ids], "doc_id LONG, quality INT, toxic INT")
    stats = qc.measured(documents(*[(i, "the same text") for i in ids], *[(ids[0], "the same text")] * 1000))
    score = stats.select(qc.fit(stats, labels).score()).first()[0]
    assert score == pytest.approx(0.75, abs=0.02)


@pytest.mark.parametrize("quality, score", [(None, 0.5), (0, 0.0), (1, 1.0)])
def test_without_both_labels(spark, documents, quality, score):
    labels = spark.createDataFrame([(1, quality, 0), (2, quality, 0), (4, quality, 0), (4, quality, 0), (None, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    stats = qc.measured(documents((1, "a"), (2, None), (4, ""), (None, "b")).withColumn("words", F.lit("x")))
    assert [r[0] for r in stats.select(qc.fit(stats, labels).score()).collect()] == [score] * 4


def test_empty_tables(spark, documents):
    stats = qc.measured(documents((1, "a")).where("false"))
    assert qc.fit(stats, spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")).constant == 0.5
