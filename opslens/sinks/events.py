"""Parsed events as Parquet by day, so that a log is parsed once and asked many times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of one day at most per write; a day with a third of all events is written by as many tasks.
FILES_PER_DAY = 16


def write_events(events: DataFrame, path: str) -> None:
    """Writes parsed events, sorted by namespace and operation within each file.

    Lines that are no operation are left out.  Events whose time cannot be read have no day.
    """
    dated = events.where("parse_status <> 'skipped'").withColumn("day", F.to_date(F.timestamp_seconds("epoch")))
    part = F.pmod(F.xxhash64("file", "chunk", "pos"), F.lit(FILES_PER_DAY))
    dated.repartition("day", part).sortWithinPartitions("day", "ns", "op").write.mode("append").partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str, ns: str | None = None, ops: list[str] | None = None,
                first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Stored events; days are pruned as folders, namespace and operation by the statistics of the files."""
    events = spark.read.parquet(path)
    if first_day:
        events = events.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        events = events.where(F.col("day") <= F.lit(last_day).cast("date"))
    if ns:
        events = events.where(F.col("ns") == ns)
    if ops:
        events = events.where(F.col("op").isin(*ops))
    return events
