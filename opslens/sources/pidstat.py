"""Process-statistics captures as series.

A capture is a list of blocks: a header line, one row for the process, rows for its
threads, and a blank line.  The header names give the column positions, shifted by one
because the header starts with a separate ``#``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.automaton import CHUNK, Machine, run

# Fixed values of the capture format.
HEADER = "%usr %system  %guest    %CPU"
COLUMNS = {"cpu": "%CPU", "mem": "%MEM", "kb_rd": "kB_rd/s", "kb_wr": "kB_wr/s"}
THREAD_COLUMNS = {"cswch": "cswch/s", "nvcswch": "nvcswch/s"}
# Samples kept: from the 10th on, up to the one before the last ten.
FIRST_SAMPLE, TAIL_SAMPLES = 10, 10


class Blocks(Machine):
    """State: 1 behind a header, where the process row stands; 2 inside a block."""
    states = 4
    texts = ("header",)
    counts = ("sample",)
    reads = ("value",)

    def step(self, state: int, memory: list, value: str) -> tuple[int, bool]:
        if HEADER in value:
            memory[0] = value
            memory[1] += 1
            return 3, False
        if value == "":
            return 0, False
        return state & 2, state != 0


def _block_lines(lines: DataFrame) -> DataFrame:
    walked = run(lines.select(*CHUNK, "pos", "value"), Blocks(), ["value"], totals=True)
    kept = (F.col("sample") >= FIRST_SAMPLE) & (F.col("sample") < F.col("total_sample") - TAIL_SAMPLES)
    return (walked.where(kept)
            .withColumn("after_header", F.col("state").bitwiseAND(F.lit(1)) == 1)
            .withColumn("names", F.split(F.trim("header"), r"\s+"))
            .withColumn("fields", F.split(F.trim("value"), r"\s+")))


def _field(name: str):
    at = F.array_position("names", F.lit(name)) - 2
    return F.get("fields", at.cast("int")).try_cast("double")


def pidstat_series(lines: DataFrame) -> DataFrame:
    """``file, sample, ts`` and the six series; switches are summed over the threads."""
    is_process = F.col("after_header")
    rows = _block_lines(lines).select(
        "file", F.col("sample").cast("int").alias("sample"),
        F.when(is_process, F.get("fields", F.lit(0)).try_cast("bigint")).alias("ts"),
        *[F.when(is_process, _field(c)).alias(n) for n, c in COLUMNS.items()],
        *[F.when(~is_process, _field(c)).alias(n) for n, c in THREAD_COLUMNS.items()],
    )
    return rows.groupBy("file", "sample").agg(
        F.max("ts").alias("ts"), *[F.max(n).alias(n) for n in COLUMNS],
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in THREAD_COLUMNS])


def pidstat_process(lines: DataFrame) -> DataFrame:
    """``file, process``: last word of the first kept process row."""
    first = _block_lines(lines).where("after_header").groupBy("file").agg(
        F.min_by(F.get("fields", F.size("fields") - 1), "sample").alias("process"))
    return first
