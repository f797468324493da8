"""What several operators of this subpackage share: tables, written intermediates, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import scratch_dir

#: A word, wherever a contract counts words: anything but ASCII white space.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again: computed once, and safe when an executor is lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, in order; no words for a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body uses it in a nested function."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` learnable labels, one per document, chosen by a hash of the identifier.

    The limit is the proof that the sample may be broadcast.  Documents labelled twice count
    once, with the larger label; rows without identifier or label are no labels.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def one_row_each(rows: DataFrame, *by: str) -> DataFrame:
    """One of the rows that agree in the columns ``by``: the one whose other columns have the smallest hash, whatever their order."""
    rest = [c for c in rows.columns if c not in by]
    least = F.min(F.struct(F.xxhash64(*rest).alias("__hash"), *rest)).alias("__row")
    return rows.groupBy(*by).agg(least).select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Large and small star steps by turns: each keeps the components and at most doubles the rows, and after
    a logarithmic number of rounds every node points at its root.  Each round is written to the shared
    folder.  A node with a third of all edges is a hot join key only, never a list in one row.
    """
    one_way = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, seen = saved(one_way, "edges"), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = saved(below.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
