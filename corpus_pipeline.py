"""A corpus pipeline: toxic documents go, near duplicates go, secrets are blanked, sources are mixed, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it left.  All but the last return the columns of
``docs``.  Null texts pass every stage (the mix takes no words of them); empty tables stay empty; columns beyond those of the
documents are carried along; repeated rows are one document after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import mixing, packing, secrets, simhash, toxicity
from opslens.llm._common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, does not reject."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(lexicon, F.col("text")) < toxicity.REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at three differing bits of 64: the one with the smallest identifier."""
    return simhash.one_of_each(docs, simhash.EXACT64)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), secrets.redacted(F.col("text")).alias("new"))
    length = F.when(F.col("new").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("new").cast("long"))
    changed = {"text": F.col("new"), "n_chars": length}
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight: documents left out, whole, repeated, or cut to the blocks that were taken."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", blank_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Learned lexicons, linked components and genetic packing cannot be written as SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
