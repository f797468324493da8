import random

import pytest

from opslens.llm import toxicity
from opslens.llm._common import held_out
from pyspark.sql import functions as F

WORDS = [a + b for a in "ba be bi bo bu da de di do du ga ge gi".split() for b in "la le li lo lu na ne ni no nu".split()]


def corpus(seed=2, count=400):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for bad in rng.sample(["grumbold", "fnarg", "zwickel" + rng.choice(["an", "en", "in", "on"])], 2):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id LONG, quality INT, toxic INT")
    return documents, labels, toxicity.fit(documents, labels)


def test_fold():
    assert toxicity.fold("1d10t IDIOT!! Ídïot іdiоt pa$$word i​diot") == "idiot idiot   idiot idiot password idiot"
    assert toxicity.fold("word$$$ 2024 10%") == "word    2024 10%"


def test_held_out_labels(spark, learned):
    documents, labels, lexicon = learned
    got = documents.select("doc_id", held_out(F.col("doc_id")).alias("h"), toxicity.score(lexicon, F.col("text")).alias("s")).join(labels, "doc_id").toPandas()
    tested = got[got.h]
    assert len(tested) > 50 and ((tested.s >= toxicity.REJECT).astype(int) == tested.toxic).all()
    assert {"grumbold", "fnarg"} <= {t for t, _, _ in lexicon.entries}
    assert any(t.startswith("zwick") and not whole for t, whole, _ in lexicon.entries)


def test_repeated_rows_are_learned_from_once(spark, learned):
    """One identifier with thousands of rows, of one text or of several: the fit is that of one row each."""
    def same(one, two):
        return one.entries == two.entries and one.curve == pytest.approx(two.curve, rel=1e-6)

    documents, labels, lexicon = learned
    again = documents.where(~held_out(F.col("doc_id"))).orderBy("doc_id").limit(1)
    many = again.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5000)))).select("doc_id", "text")
    assert same(toxicity.fit(documents.unionAll(many), labels), lexicon)
    other = documents.unionAll(again.select("doc_id", F.explode(F.array(*[F.lit(f"fnarg text {i}") for i in range(50)]))))
    assert same(toxicity.fit(other.repartition(5), labels), toxicity.fit(other.unionAll(other).orderBy(F.desc("text")), labels))


def test_held_out_labels_are_not_learned_from(learned):
    documents, labels, lexicon = learned
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(documents, flipped) == lexicon


def test_large_vocabulary_is_kept_whole():
    """More than a thousand words, each in 12 toxic documents and in no other."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(1500)})
    documents = [(set(words[i % 15::15]), (i, i, i)) for i in range(180)]
    got = toxicity.chosen({w: (0, 5.0) for w in words}, documents, 0.05, 10 * len(words))
    assert sorted(p for p, _ in got) == words


def brute_hits(text, lexicon):
    folded, found = toxicity.fold(text), {}
    for entry, whole, weight in lexicon.entries:
        at = folded.find(entry)
        while at >= 0:
            end = at + len(entry)
            starts = at == 0 or not folded[at - 1].isalpha()
            if starts and (not whole or end == len(folded) or not folded[end].isalpha()):
                found[at] = max(found.get(at, 0), weight)
            at = folded.find(entry, at + 1)
    return sum(found.values())


def test_automaton_equals_brute_force(learned):
    lexicon = learned[2]
    automaton = lexicon.automaton()
    for _, text, _ in corpus(seed=8, count=60):
        assert toxicity.features(text, automaton)[0] == pytest.approx(brute_hits(text, lexicon))


def test_exceptions_cancel_and_length_counts():
    lexicon = toxicity.Lexicon((("trash", True, 3.0), ("lowe", False, 2.0)), ("trash can",), (-2.0, 3.0, -0.5))
    automaton = lexicon.automaton()
    assert toxicity.features("the trash can is full", automaton)[0] == 0
    assert toxicity.features("you trash", automaton) == (3.0, 2)
    assert toxicity.features("loweian lowe slowed Trash!", automaton)[0] == 7.0
    short, long = (toxicity.probability(*toxicity.features(t, automaton), lexicon.curve) for t in ("you trash", "you trash " + "word " * 500))
    assert short > long


def test_rows_of_every_kind(spark, learned):
    lexicon = learned[2]
    df = spark.createDataFrame([(1, None), (2, ""), (None, "fnarg fnarg"), (3, "bala " * 20000 + "fnarg grumbold")], "doc_id LONG, text STRING")
    got = [r["s"] for r in df.select(toxicity.score(lexicon, F.col("text")).alias("s")).collect()]
    assert got[0] == got[1] and got[2] > 0.7 and all(0 <= s <= 1 for s in got)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_without_both_labels(spark, toxic):
    documents = spark.createDataFrame([(1, "a"), (2, None)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(1, 1, toxic), (2, 1, toxic), (None, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    lexicon = toxicity.fit(documents, labels)
    assert [r["s"] < 0.01 for r in documents.select(toxicity.score(lexicon, F.col("text")).alias("s")).collect()] == [True, True]


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert toxicity.fit(documents, labels).entries == ()
