"""Questions over operation-log and profiler records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.workload import counts, is_op
from opslens.sources.oplog import INSERT, UPDATE


def is_insert() -> Column:
    return F.col("op") == INSERT


def is_update() -> Column:
    return F.col("op") == UPDATE


def ns_counts(changes: DataFrame) -> DataFrame:
    return counts(changes, "ns")


def group_key() -> Column:
    """``i-g`` of the document; missing members are empty."""
    return F.concat(F.coalesce("i", F.lit("")), F.lit("-"), F.coalesce("g", F.lit("")))


def distinct_groups(changes: DataFrame, ns: str) -> DataFrame:
    """Number of distinct ``i-g`` pairs among the inserts of one namespace."""
    chosen = changes.where(is_insert() & (F.col("ns") == ns))
    return chosen.agg(F.count_distinct(group_key()).alias("n_groups"))


def profile_ops_per_second(records: DataFrame) -> DataFrame:
    """All, update and query rates of profiler records in one pass."""
    return records.groupBy("epoch").agg(
        F.count("*").alias("all_ops"), F.count_if(is_op("update")).alias("update_ops"),
        F.count_if(is_op("query")).alias("query_ops"))
