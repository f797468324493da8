"""Text logs as ordered, splittable lines.

Every line table has the columns ``file, chunk, pos, value``.  Inside one file,
``(chunk, pos)`` is the line order, and one chunk is never larger than one read split, so
parsers that need neighbouring lines work chunk by chunk (see ``operators.carry``) and a
single huge file still spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A chunk of rendered rows holds 2 ** CHUNK_BITS rows.
CHUNK_BITS = 14


def log_lines(spark: SparkSession, paths: str | list[str], spread: bool = False) -> DataFrame:
    """Lines of text files; the read split is the chunk, so files stay splittable.

    A compressed file is read by one task.  ``spread`` cuts a split into chunks of ``2 ** CHUNK_BITS`` lines and deals them to all
    tasks, so that whatever follows the one read is spread over the cluster.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value"),
    )
    if not spread:
        return lines
    # Every line has a byte, so the number of a line's chunk never reaches the start of the next split.
    nth = F.shiftright(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)), CHUNK_BITS)
    return lines.withColumn("chunk", F.col("chunk") + nth).repartition("file", "chunk")


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that each hold one JSON value, one row per file."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def rows_as_lines(df: DataFrame, file: Column, order: Column, lines: list[Column]) -> DataFrame:
    """Render each row as one or more lines; ``order`` is a unique whole number per row.

    A NULL line is left out.
    """
    width = len(lines)
    exploded = df.select(file.alias("file"), order.alias("ord"), F.posexplode(F.array(*lines)))
    return exploded.where("col IS NOT NULL").select(
        "file", F.shiftright("ord", CHUNK_BITS).alias("chunk"),
        (F.col("ord") * width + F.col("pos")).alias("pos"), F.col("col").alias("value"))


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each file.

    Chunk sizes are counted first, which is a small table, so each chunk knows how many
    of its own lines belong to the prefix.  Only the boundary chunk is cut.
    """
    counts = lines.groupBy("file", "chunk").agg(F.count("*").alias("chunk_lines"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.select(
        "file", "chunk", (F.lit(n) - F.coalesce(F.sum("chunk_lines").over(before), F.lit(0))).alias("quota"),
    ).where("quota > 0")
    in_chunk = Window.partitionBy("file", "chunk").orderBy("pos")
    return (lines.join(quota, ["file", "chunk"])
            .withColumn("rank", F.row_number().over(in_chunk))
            .where("rank <= quota").drop("rank", "quota"))
