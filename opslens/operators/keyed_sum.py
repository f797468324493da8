"""Sums per key, their merge into stored totals, and the check of merged totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, VALUE = "_id", "value"


def keyed_reduce(rows: DataFrame, key: Column, value: Column,
                 how: Callable[[str], Column] = F.sum) -> DataFrame:
    """Map each row to ``(key, value)`` and reduce per key with a built-in aggregate."""
    return rows.select(key.alias(KEY), value.alias(VALUE)).groupBy(KEY).agg(how(VALUE).alias(VALUE))


#: Aggregates that can be merged, with the aggregate that merges their results.
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def merge_totals(*totals: DataFrame, reducer: str = "sum") -> DataFrame:
    """Reduce totals with totals, as if they had been one input; ``reducer`` made them."""
    return reduce(DataFrame.unionByName, totals).groupBy(KEY).agg(merging(reducer)(VALUE).alias(VALUE))


def merging(reducer: str) -> Callable[[str], Column]:
    if reducer not in MERGES:
        raise ValueError(f"results of {reducer} cannot be merged; known are {', '.join(MERGES)}")
    return MERGES[reducer]


def check_totals(single: DataFrame, merged: DataFrame, times: int) -> DataFrame:
    """Keys whose merged total is not ``times`` the single total; missing keys are mismatches."""
    both = single.withColumnRenamed(VALUE, "single").join(merged.withColumnRenamed(VALUE, "merged"), KEY, "full_outer")
    return both.where(~F.col("merged").eqNullSafe(F.col("single") * times))


class StoredTotals:
    """Totals kept as one folder of partial results per reducer, job and batch.

    Writing a batch again overwrites its own folder, so a replayed batch changes nothing, and
    a merge never rewrites what is already stored.  Jobs that share a store have names of
    their own.  The reducer is part of the folder's name, and a store that holds results of
    another one is refused.
    """

    def __init__(self, spark: SparkSession, path: str, reducer: str = "sum", fold: Callable[[DataFrame], DataFrame] | None = None):
        """``fold`` makes one row for each key out of several; it gives ``reducer``, then any name, its meaning."""
        if fold is None:
            merging(reducer)
        self.spark, self.path, self.reducer, self.fold = spark, path, reducer, fold

    def merge(self, totals: DataFrame, batch: int, job: str = "main") -> None:
        totals.write.mode("overwrite").parquet(f"{self.path}/reducer={self.reducer}/job={job}/batch={batch}")

    def read(self) -> DataFrame:
        stored = self.spark.read.parquet(self.path)
        other = [r[0] for r in stored.select("reducer").distinct().collect() if r[0] != self.reducer]
        if other:
            raise ValueError(f"{self.path} holds results of {', '.join(other)}, not of {self.reducer}")
        totals = stored.select(KEY, VALUE)
        return merge_totals(totals, reducer=self.reducer) if self.fold is None else self.fold(totals)

    def compact(self, path: str) -> StoredTotals:
        """The same totals in a new folder; they have a job name that no other job takes."""
        compacted = StoredTotals(self.spark, path, self.reducer, self.fold)
        compacted.merge(self.read(), 0, job=f"compacted-{uuid.uuid4().hex}")
        return compacted
