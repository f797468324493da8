"""An event store that is loaded by file, with partial counts beside the events.

Every load has a key, the name of the log or of the delivery it comes from, and writes a folder of its own: loading it again
replaces that folder, and other loads are not touched.  Three tables share the keys:

* ``events``   the parsed events by day, in files of about ``FILE_EVENTS`` events, with a Bloom filter on the namespace
* ``seconds``  operations by second
* ``kinds``    operations by day, operation, namespace, command and decoded operation

Counts of the last two add up over loads and days, so questions about rates and load are answered from them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators.workload import in_namespace
from opslens.sources.dblog import db_name, op_read, parsed_or_failed

#: Events of one file.
FILE_EVENTS = 2_000_000
KINDS = ["op", "ns", "cmd", "op_read"]
#: Logarithm of the registers of a sketch, and the standard error of its estimates.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def load_events(events: DataFrame, path: str, load: str) -> None:
    """Writes the events of one load and their partial counts; the same load again changes nothing.

    Lines that are no operation are left out.  Events whose time cannot be read have no day.  The number of files of a day
    follows the events of that day, so a day with most of a load is still written by many tasks.
    """
    dated = parsed_or_failed(events).withColumn("day", F.to_date(F.timestamp_seconds("epoch")))
    files = dated.groupBy("day").agg(F.ceil(F.count("*") / FILE_EVENTS).alias("files"))
    keys = [F.xxhash64("file", "chunk", "pos")]
    dealt = dated.join(files, dated["day"].eqNullSafe(files["day"])).drop(files["day"]).withColumn("part", F.pmod(*keys, F.col("files")))
    folder = lambda table: f"{path}/{table}/load={load}"
    (dealt.repartition("day", "part").sortWithinPartitions("day", "ns", "op").drop("files", "part", "skipped")
     .write.mode("overwrite").partitionBy("day").option("parquet.bloom.filter.enabled#ns", "true").parquet(folder("events")))
    stored = SparkSession.active().read.schema(dated.drop("skipped").schema).parquet(folder("events"))
    stored.groupBy("epoch", "op").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(folder("seconds"))
    kinds = stored.withColumn("op_read", op_read()).groupBy("day", *KINDS).agg(F.count("*").alias("n"))
    kinds.write.mode("overwrite").parquet(folder("kinds"))


def loaded_events(spark: SparkSession, path: str, ns: str | None = None) -> DataFrame:
    """Events of all loads; a namespace is looked for in the Bloom filters of the files first."""
    events = spark.read.parquet(f"{path}/events")
    return events if ns is None else events.where(in_namespace(ns))


def rates(spark: SparkSession, path: str, *, by_op: bool = False) -> DataFrame:
    """Operations per second, from the partial counts."""
    keys = ["epoch", "op"] if by_op else ["epoch"]
    return spark.read.parquet(f"{path}/seconds").groupBy(*keys).agg(F.sum("n").alias("n"))


def kind_counts(spark: SparkSession, path: str, *keys: str | Column, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Events by any of ``day``, ``op``, ``ns``, ``cmd``, ``op_read`` (or expressions of them), from the partial counts."""
    kinds = spark.read.parquet(f"{path}/kinds")
    if first_day:
        kinds = kinds.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        kinds = kinds.where(F.col("day") <= F.lit(last_day).cast("date"))
    return kinds.groupBy(*keys).agg(F.sum("n").alias("n"))


def database() -> Column:
    return db_name(F.col("ns")).alias("db")


# ---------------------------------------------------------------- distinct counts that merge

def write_sketches(rows: DataFrame, day: Column, value: Column, path: str, load: str) -> None:
    """A sketch of the distinct values of each day, under the key of its load."""
    named = rows.select(day.alias("day"), value.alias("value")).where("value IS NOT NULL")
    sketches = named.groupBy("day").agg(F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch"))
    sketches.write.mode("overwrite").parquet(f"{path}/load={load}")


def distinct_estimate(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Distinct values over all loads, for each of ``keys`` (``day``) or in all; stored values are not read again."""
    sketches = spark.read.parquet(path)
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
