import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from opslens.llm import mixing, packing, secrets, toxicity
from opslens.llm._common import saved
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), "test-stage")
        after[name] = (before.toPandas(), docs.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    # Toxicity: exactly the documents that the lexicon rejects are gone.
    before, kept = after["toxicity"]
    lexicon = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    automaton = lexicon.automaton()
    clean = {i for i, t in zip(before.doc_id, before.text) if toxicity.probability(*toxicity.features(t, automaton), lexicon.curve) < toxicity.REJECT}
    assert set(kept.doc_id) == clean
    # Near duplicates: the smallest identifier of each group of fingerprints that link at three bits stays.
    before, kept = after["simhash_near_dedup"]
    prints = {i: brute_fingerprint(t) for i, t in zip(before.doc_id, before.text)}
    ids = list(prints)
    smallest = brute_components(ids, lambda i, j: (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 3)
    assert sorted(kept.doc_id) == sorted(set(smallest.values())) and len(kept) < len(before)
    # Secrets: every document stays, without its spans.
    before, kept = after["secret_scan"]
    assert dict(zip(kept.doc_id, kept.text)) == {i: secrets.redact(t) for i, t in zip(before.doc_id, before.text)}
    assert (kept.n_chars == kept.text.str.len()).all()
    # Mix: words by source near the targets, no document above its limit.
    before, kept = after["source_mix"]
    count = lambda t: len(re.findall(mixing.WORD, t))
    size = before.assign(words=before.text.map(count)).groupby("doc_id").words.sum()
    taken = kept.assign(words=kept.text.map(count)).groupby("doc_id").words.sum()
    assert (taken <= 3 * size.loc[taken.index]).all() and taken.sum() == pytest.approx(size.sum(), rel=0.03)
    # Packing: every row that came is there.
    before, packed = after["best_fit_packing"]
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(before.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_rows_of_every_kind(spark, documents, sf):
    rows = documents((1, None), (1, None), (2, ""), (None, "a null identifier of some words"), (3, "token=abcdefgh12 here", None), (4, "x " * 3000), (5, "x " * 3000), (5, "x " * 3000)).withColumn("__text", F.lit("extra")).withColumn("fp", F.lit(1)).withColumn("row", F.lit("r"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    folder = sf(labels=labels, documents=rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), "test-stage")
        assert docs.columns == rows.columns
        assert {(r["__text"], r["fp"], r["row"]) for r in docs.collect()} == {("extra", 1, "r")}
        if name == "simhash_near_dedup":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 3, 4]
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_tables(spark, documents, sf):
    folder = sf(labels=spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT"), documents=documents((1, "x")).where("false"))
    assert corpus_pipeline.run(spark, folder).count() == 0
