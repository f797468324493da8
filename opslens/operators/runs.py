"""Results of benchmark captures, whatever tool wrote them.

A new tool is added to ``READERS``: a function from lines to ``run, harness, workload,
throughput, attributes``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.perf import mean_cv
from opslens.sources import captures
from opslens.sources.perf_log import perf_samples

Reader = Callable[[DataFrame], DataFrame]


def _row(harness: str, throughput: Column, attributes: Column, workload: Column | None = None) -> list[Column]:
    run = F.col("file")
    return [run.alias("run"), F.lit(harness).alias("harness"), (run if workload is None else workload).alias("workload"),
            throughput.cast("double").alias("throughput"), attributes.cast("map<string,string>").alias("attributes")]


def _tool(harness: str) -> Reader:
    spec = captures.HARNESSES[harness]
    names = [name for name in spec.parameters if name != spec.result_parameter] + ["status"]

    def read(lines: DataFrame) -> DataFrame:
        pairs = [F.lit("test-type"), F.lit(harness)]
        for name in names:
            pairs += [F.lit(name), F.col(f"`{name}`")]
        return captures.summary(lines, harness).select(_row(spec.report_name, F.col("throughput"), F.create_map(*pairs)))
    return read


def _ycsb(lines: DataFrame) -> DataFrame:
    return captures.ycsb_summary(lines).select(_row("ycsb", F.col("throughput"), F.create_map()))


def _sim(lines: DataFrame) -> DataFrame:
    return captures.sim_run(lines).select(_row("mongo-sim", F.lit(None), F.col("attributes")))


def _perf(lines: DataFrame) -> DataFrame:
    attributes = F.create_map(F.lit("nThread"), F.col("thread").cast("string"), F.lit("CV"), F.col("cv_str"))
    return mean_cv(perf_samples(lines)).select(_row("mongo-perf", F.col("mean"), attributes, F.col("name")))


READERS: dict[str, Reader] = {
    **{harness: _tool(harness) for harness in captures.HARNESSES},
    "ycsb": _ycsb, "mongo-sim": _sim, "mongo-perf": _perf,
}


def results(lines: DataFrame, harness: str) -> DataFrame:
    """``run, harness, workload, throughput, attributes`` of every capture in ``lines``."""
    return READERS[harness.lower()](lines)
