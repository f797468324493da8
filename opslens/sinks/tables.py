"""Comparison tables as plain text and as wiki markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.session import scratch_dir

# Fixed values of the table formats.
TEXT_HEADER = ["benchmark", "old ns/op", "new ns/op", "delta"]
WIKI_HEADER = ["||benchmark", "||baseline ns/op", "||cv baseline", "||new ns/op", "||cv new", "||delta|"]
PADDING = 5
RED, ORANGE, END = "{color:red}", "{color:orange}", "{color}"


def _fixed(value: str, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", F.col(value))


def text_cells(compared: DataFrame) -> DataFrame:
    """Adds ``cells``: benchmark, old and new mean with CV, and delta or ``n/a``."""
    with_cv = lambda mean, cv: F.concat(mean, F.lit("["), F.col(cv), F.lit("]"))
    has_old = F.col("old_mean").isNotNull()
    old = F.when(has_old, with_cv(_fixed("old_mean"), "old_cv_str")).otherwise("n/a")
    new = with_cv(F.when(has_old, _fixed("new_mean")).otherwise(_fixed("new_mean", 6)), "new_cv_str")
    delta = F.when(has_old, F.col("delta")).otherwise("n/a")
    return compared.withColumn("cells", F.array("key", old, new, delta))


def wiki_cells(compared: DataFrame) -> DataFrame:
    """The same as wiki cells: red for regressions, orange for noisy results."""
    def coloured(text: str, flag: str, colour: str) -> Column:
        return F.when(F.col(flag), F.concat(F.lit(colour), F.col(text), F.lit(END))).otherwise(F.col(text))

    cell = lambda value: F.concat(F.lit("|"), value)
    name = F.concat(F.lit("||"), F.col("key"))
    both = F.array(
        name, cell(_fixed("old_mean")), cell(coloured("old_cv_str", "old_noisy", ORANGE)),
        cell(_fixed("new_mean")), cell(coloured("new_cv_str", "new_noisy", ORANGE)),
        F.concat(F.lit("|"), coloured("delta", "regression", RED), F.lit("|")))
    alone = F.array(
        name, F.lit("|n/a"), cell(_fixed("new_mean", 6)),
        F.concat(F.lit("|["), F.col("new_cv_str"), F.lit("]")), F.lit("|n/a|"))
    return compared.withColumn("cells", F.when(F.col("old_mean").isNotNull(), both).otherwise(alone))


def tab_lines(cells: DataFrame) -> DataFrame:
    return cells.withColumn("line", F.array_join("cells", "\t"))


def aligned_lines(cells: DataFrame, header: list[str]) -> DataFrame:
    """Header and rows with cells padded to the widest cell of their column.

    Cells are written first, so that taking the widths does not compute them a second time.  The last cell of a row is not padded.
    """
    path = scratch_dir(cells.sparkSession, "cells")
    cells.select("key", "cells").write.parquet(path)
    cells = cells.sparkSession.read.parquet(path)
    columns = len(header)
    cell = lambda i: F.get("cells", F.lit(i))
    padded = lambda i: F.size("cells") > i + 1
    width = lambda i: F.greatest(F.coalesce(F.max(F.when(padded(i), F.length(cell(i)))), F.lit(0)), F.lit(len(header[i])))
    widths = cells.agg(F.struct(*[(width(i) + PADDING).alias(f"w{i}") for i in range(columns - 1)]).alias("w")).scalar()
    head = cells.sparkSession.range(1).select(
        F.lit("").alias("key"), F.array(*[F.lit(h) for h in header]).alias("cells"))
    rows = head.unionByName(cells.select("key", "cells")).withColumn("w", widths)
    aligned = [F.when(padded(i), F.rpad(cell(i), F.col("w").getField(f"w{i}"), F.lit(" "))).otherwise(
        F.coalesce(cell(i), F.lit(""))) for i in range(columns - 1)]
    return rows.select("key", F.concat(*aligned, F.coalesce(cell(columns - 1), F.lit(""))).alias("line"))


def head_lines(info: DataFrame, old_file: str, new_file: str) -> DataFrame:
    """``line_no, value``: which two logs are compared, with version and hash of each from ``perf_log_info``."""
    names = F.create_map(F.lit(old_file), F.lit("baseline"), F.lit(new_file), F.lit("new results"))
    known = info.where(F.col("file").isin(old_file, new_file))
    value = F.format_string("# %s : %s [%s | SHA: %s]", F.try_element_at(names, F.col("file")), "file", F.coalesce("version", F.lit("")), F.coalesce("git_sha", F.lit("")))
    return known.select(F.when(F.col("file") == old_file, 0).otherwise(1).alias("line_no"), value.alias("value"))


def text_table(compared: DataFrame, wiki: bool = False, aligned: bool = True) -> DataFrame:
    """Lines of the table in order; ``df.write.text`` stores them."""
    cells = wiki_cells(compared) if wiki else text_cells(compared)
    lines = aligned_lines(cells, WIKI_HEADER if wiki else TEXT_HEADER) if aligned else tab_lines(cells)
    return lines.orderBy("key").select(F.col("line").alias("value"))
