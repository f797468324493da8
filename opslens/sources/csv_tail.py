"""Tail of CSV result files.

A record is one line, or several where a quoted field holds line ends.  Whether a line begins a record depends on the
quotes of all lines before it, so files are walked chunk by chunk by a machine with two states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.automaton import Machine, run


class Records(Machine):
    """State 1 inside a quoted field at the end of a line.  Only the ends of a chunk are kept."""
    states = 2
    counts = ("record",)
    reads = ("value",)
    ends = 2

    def step(self, state: int, memory: list, value: str) -> tuple[int, bool]:
        if state == 0:
            if not value.strip():
                return 0, False
            memory[0] += 1
        return state ^ (value.count('"') & 1), True


def csv_fields(record: Column) -> Column:
    """The fields of a record without their quotes."""
    found = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(r'(?:"(?:[^"]|"")*"|[^,]*),'), F.lit(0))
    inner = lambda field: F.substring(field, F.lit(1), F.length(field) - 1)
    quoted = lambda field: field.startswith('"') & field.endswith('"') & (F.length(field) > 1)
    plain = lambda field: F.when(quoted(field), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)
    return F.transform(found, lambda f: plain(inner(f)))


def csv_tail_summary(lines: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per file: the header and the second-to-last data row, as text; ``csv_fields`` takes them apart.

    ``last_row`` is NULL when a file has fewer than two data rows.  Blank lines do not count, but for those inside quotes.
    A file that ends inside quotes has no last rows that could be told apart: ``unbalanced``, with a NULL row, or no row at all
    where it never leaves its first record.  Files listed
    in ``expected`` (column ``file``) that have no lines are reported with ``missing``.  Every row carries its own header,
    so a change of header between files shows in the rows.
    """
    walked = run(lines, Records(), ["value"], totals=True)
    is_head = F.col("record") == 1
    is_tail = (F.col("record") == F.col("total_record") - 1) & (F.col("final_state") == 0) & ~is_head
    kept = walked.where(is_head & ((F.col("total_record") > 1) | (F.col("final_state") == 0)) | is_tail)
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "pos", "value")))
    records = kept.groupBy("file", is_head.alias("head"), "final_state").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("text"))
    out = records.groupBy("file").agg(
        F.max(F.when(F.col("head"), F.col("text"))).alias("header"), F.max(F.when(~F.col("head"), F.col("text"))).alias("last_row"),
        (F.max("final_state") == 1).alias("unbalanced"))
    if expected is not None:
        out = expected.select("file").distinct().join(out, "file", "left").withColumn("unbalanced", F.coalesce("unbalanced", F.lit(False)))
    return out.withColumn("missing", F.col("header").isNull() & ~F.col("unbalanced"))
