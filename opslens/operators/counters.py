"""Differences between counter snapshots taken before and after a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.sources import shell_json

# Zero-based fields of the process status line.
USER_TICKS, SYSTEM_TICKS = 13, 14
BEFORE, AFTER = "before", "after"


def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """``run, phase, time_ms`` and the texts ``counters_text, proc_text`` as numbers."""
    ticks = lambda i: F.get("f", F.lit(i)).try_cast("bigint")
    counted = shell_json.with_operations(snapshots, "counters_text", "ops")
    fields = counted.withColumn("f", F.split(F.trim("proc_text"), r"\s+"))
    return fields.select("run", "phase", "time_ms", "ops", ticks(USER_TICKS).alias("utime"),
                         ticks(SYSTEM_TICKS).alias("stime"))


def _change(name: str) -> Column:
    sign = F.when(F.col("phase") == AFTER, 1).when(F.col("phase") == BEFORE, -1)
    return F.sum(sign * F.col(name))


def run_costs(parsed: DataFrame) -> DataFrame:
    """Per run: operations, ticks, ticks per operation and run time; no self-join."""
    changes = parsed.groupBy("run").agg(
        _change("ops").alias("total_ops"), _change("utime").alias("utime"),
        _change("stime").alias("stime"), _change("time_ms").alias("run_ms"))
    return changes.withColumn("ticks_per_op", F.try_divide(F.col("utime") + F.col("stime"), F.col("total_ops")))
