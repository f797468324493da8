"""Operation-log records (one JSON object per line) and exported profiler records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.sources.lines import log_lines

# Operation codes of the operation log.
INSERT, UPDATE = "i", "u"

RECORD = "op STRING, ns STRING, o STRING"
DOCUMENT = "_id STRING, i STRING, g STRING"


def parse_oplog(lines: DataFrame) -> DataFrame:
    """``op``, ``ns``, the members of the document that the analyses use, and its JSON text.

    A line that holds no JSON object keeps its row, with NULL fields.
    """
    record = lines.select("file", "chunk", "pos", F.from_json("value", RECORD).alias("r"))
    read = record.select("file", "chunk", "pos", "r.op", "r.ns", F.col("r.o").alias("doc"))
    return (read.withColumn("o", F.from_json("doc", DOCUMENT))
            .select("file", "chunk", "pos", "op", "ns",
                    F.col("o._id").alias("doc_id"), F.col("o.i").alias("i"), F.col("o.g").alias("g"), "doc"))


def read_oplog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_oplog(log_lines(spark, paths))


def read_profile(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Exported profiler records, JSON lines or Parquet: ``ts``, ``epoch``, ``op``."""
    return profile_events(spark.read.schema("ts TIMESTAMP, op STRING").format(fmt).load(path))


def profile_events(records: DataFrame) -> DataFrame:
    return records.select("ts", F.unix_timestamp("ts").alias("epoch"), "op")
