"""Benchmark statistics and baseline-against-new comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.sources.perf_log import sample_key

# A change below -5 % is a regression, a CV above 3 % is noise.
REGRESSION = -0.05
NOISY_CV = 3.0
# Fixed value: what is printed in place of a CV when no result could be read.
NO_SAMPLES = "Error, no data for cvStr"


def cv_percent(mean: Column, sd: Column) -> Column:
    return 100 * sd / mean


def cv_text(n: Column, mean: Column, sd: Column) -> Column:
    """Coefficient of variation as text; one sample has none, and no sample is an error text."""
    return F.when(n == 1, "n/a").when(n == 0, NO_SAMPLES).otherwise(F.format_string("%.2f%%", cv_percent(mean, sd)))


def percent_text(ratio: Column) -> Column:
    return F.format_string("%+.2f%%", 100 * ratio - 100)


def speedup_text(ratio: Column) -> Column:
    return F.format_string("%.2fx", ratio)


def mean_cv(samples: DataFrame) -> DataFrame:
    """Mean and CV per file, benchmark and thread count."""
    stats = samples.groupBy("file", "name", "thread").agg(
        F.count("result").alias("n"), F.avg("result").alias("mean"), F.stddev_samp("result").alias("sd"))
    return stats.select(
        "file", "name", "thread", "n", "mean",
        cv_percent(F.col("mean"), F.col("sd")).alias("cv"),
        cv_text(F.col("n"), F.col("mean"), F.col("sd")).alias("cv_str"))


def _flags(joined: DataFrame) -> DataFrame:
    ratio = F.col("new_mean") / F.col("old_mean")
    # The noise test reads the printed text up to its first decimal, so 3.00 to 3.09 passes.
    printed = lambda cv: F.floor(F.round(F.col(cv), 2) * 10 + 1e-6) / 10
    noisy = lambda cv: F.coalesce(printed(cv) > NOISY_CV, F.lit(False))
    return joined.select(
        sample_key(F.col("name"), F.col("thread")).alias("key"), "name", "thread",
        "old_mean", "old_cv", "old_cv_str", "new_mean", "new_cv", "new_cv_str",
        ratio.alias("ratio"), percent_text(ratio).alias("delta"),
        F.coalesce(ratio - 1 < REGRESSION, F.lit(False)).alias("regression"),
        noisy("old_cv").alias("old_noisy"), noisy("new_cv").alias("new_noisy"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each benchmark of ``new`` beside its baseline; both from ``mean_cv``.

    Benchmarks only in the baseline are left out; those without one have NULL old values.
    """
    side = lambda stats, prefix: stats.select(
        "name", "thread", *[F.col(c).alias(f"{prefix}_{c}") for c in ("mean", "cv", "cv_str")])
    return _flags(side(new, "new").join(side(old, "old"), ["name", "thread"], "left"))


def compare_files(samples: DataFrame, old_file: str, new_file: str) -> DataFrame:
    """The same for two files of one sample table, in a single aggregation without a join.

    Read only the two logs into ``samples``: a filter on ``file`` up here would reach one use
    of the shared line shuffle and not the other, and the log would be read twice.
    """
    def side(prefix: str, file: str) -> list[Column]:
        value = F.when(F.col("file") == file, F.col("result"))
        return [F.count(value).alias(f"{prefix}_n"), F.avg(value).alias(f"{prefix}_mean"),
                F.stddev_samp(value).alias(f"{prefix}_sd")]

    stats = (samples.groupBy("name", "thread")
             .agg(*side("old", old_file), *side("new", new_file)).where("new_n > 0"))
    for prefix in ("old", "new"):
        n, mean, sd = (F.col(f"{prefix}_{c}") for c in ("n", "mean", "sd"))
        stats = (stats.withColumn(f"{prefix}_cv", cv_percent(mean, sd))
                 .withColumn(f"{prefix}_cv_str", F.when(n > 0, cv_text(n, mean, sd))))
    return _flags(stats)
