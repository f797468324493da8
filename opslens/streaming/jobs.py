"""Streaming versions of the rate, totals and distinct-client queries.

Each job follows a growing folder and ends when everything there now is processed
(``availableNow``); started again with the same folders it goes on where it stopped.

Lines come from ``follow_lines`` (each file is read once) or from ``sources.growing.follow_growing`` (files that grow).  The
``windowed_rates`` and ``recent_agents`` jobs keep their state in Spark's state store, bounded by a delay in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opslens.operators.keyed_sum import StoredTotals, keyed_reduce
from opslens.sources.access import parse_access
from opslens.sources.dblog import parse_dblog


def follow_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New lines of a folder; streams have no line order inside a batch, so ``pos`` is 0."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
        F.lit(0).cast("bigint").alias("pos"), "value")


def _batch_folder(out: str, batch: int) -> str:
    return f"{out}/batch={batch}"


def ops_per_second_stream(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Operations per second and kind.

    Each batch writes the counts of its own lines, and reading adds them up.  So no line is
    too late, whatever the order of the files, and a replayed batch overwrites its own folder.
    """
    def store(batch_lines: DataFrame, batch: int) -> None:
        events = parse_dblog(batch_lines).where("op IS NOT NULL")
        events.groupBy("epoch", "op").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(_batch_folder(out, batch))

    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(availableNow=True).start())


def read_rates(spark: SparkSession, out: str) -> DataFrame:
    """Counts of each second and kind over all batches."""
    return spark.read.parquet(out).groupBy("epoch", "op").agg(F.sum("n").alias("n"))


def totals_stream(rows: DataFrame, key: str, value: str, out: str, checkpoint: str,
                  job: str = "stream") -> StreamingQuery:
    """Merges the sums of every batch into stored totals; a replayed batch changes nothing.

    ``job`` tells this stream from others that write to the same store.
    """
    store = StoredTotals(rows.sparkSession, out)

    def merge(batch_rows: DataFrame, batch: int) -> None:
        store.merge(keyed_reduce(batch_rows, F.col(key), F.col(value)), batch, job)

    return (rows.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(merge).trigger(availableNow=True).start())


def agents_stream(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Distinct agents: each batch writes its own, and reading unites them."""
    def store(batch_lines: DataFrame, batch: int) -> None:
        agents = parse_access(batch_lines).where("agent_id IS NOT NULL").select("agent_id").distinct()
        agents.write.mode("overwrite").parquet(_batch_folder(out, batch))

    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(availableNow=True).start())


def read_agents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).select("agent_id").distinct()


# ---------------------------------------------------------------- jobs whose state is bounded in time

RATES = "epoch BIGINT, op STRING, n BIGINT"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _newest(spark: SparkSession, out: str, batch: int) -> int | None:
    """The largest second of all batches up to this one."""
    path = f"{out}/newest/batch={batch}"
    return spark.read.parquet(path).first()[0] if batch >= 0 and _exists(spark, path) else None


def _split_by_lateness(lines: DataFrame, out: str, checkpoint: str, delay: int) -> StreamingQuery:
    """First hop: counts of each batch, those of seconds that are ``delay`` behind all earlier batches to a side table.

    ``newest`` is written last and marks a batch as done, so a replayed batch changes nothing.
    """
    spark = lines.sparkSession

    def store(batch_lines: DataFrame, batch: int) -> None:
        if _exists(spark, f"{out}/newest/batch={batch}"):
            return
        before = _newest(spark, out, batch - 1)
        late = F.lit(False) if before is None else F.col("epoch") < before - delay
        counts = parse_dblog(batch_lines).where("op IS NOT NULL").groupBy("epoch", "op").agg(F.count("*").alias("n")).persist()
        try:
            counts.where(~late).write.mode("overwrite").parquet(f"{out}/in_time/batch={batch}")
            counts.where(late).write.mode("overwrite").parquet(f"{out}/late/batch={batch}")
            newest = counts.agg(F.greatest(F.max("epoch"), F.lit(before).cast("bigint")).alias("epoch"))
            newest.write.mode("overwrite").parquet(f"{out}/newest/batch={batch}")
        finally:
            counts.unpersist()

    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(availableNow=True).start())


def _close_windows(spark: SparkSession, out: str, checkpoint: str, delay: int) -> StreamingQuery:
    """Second hop: counts in the state store until their second is ``delay`` behind the newest one, then appended.

    What the first hop lets through is never late here, because this watermark is at most as far as that limit.  Counts that
    were taken over are deleted from the folder between the hops.
    """
    counts = (spark.readStream.schema(RATES).option("cleanSource", "delete").parquet(f"{out}/in_time/batch=*")
              .withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", f"{delay} seconds"))
    rates = counts.groupBy(F.window("ts", "1 second"), "op").agg(F.sum("n").alias("n"))
    closed = rates.select(F.unix_timestamp("window.start").alias("epoch"), "op", "n")
    return (closed.writeStream.option("checkpointLocation", checkpoint)
            .format("parquet").option("path", f"{out}/closed").trigger(availableNow=True).start())


def windowed_rates(lines: DataFrame, out: str, checkpoint: str, delay: int = 10) -> None:
    """Operations per second and kind, closed ``delay`` seconds of log time behind the newest line.

    The state store holds the open seconds only.  Later lines are counted in a side table, which reading adds.
    """
    _split_by_lateness(lines, out, f"{checkpoint}/lines", delay).awaitTermination()
    _close_windows(lines.sparkSession, out, f"{checkpoint}/windows", delay).awaitTermination()


def open_rates(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The seconds that are not closed yet, from the state store."""
    state = spark.read.format("statestore").load(f"{checkpoint}/windows")
    return state.select(F.unix_timestamp("key.window.start").alias("epoch"), F.col("key.op").alias("op"), F.col("value.sum").alias("n"))


def read_windowed_rates(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """Counts of each second and kind: closed, open and late."""
    stored = [spark.read.schema(RATES).parquet(f"{out}/{part}").select("epoch", "op", "n") for part in ("closed", "late") if _exists(spark, f"{out}/{part}")]
    every = open_rates(spark, checkpoint) if _exists(spark, f"{checkpoint}/windows/state") else spark.createDataFrame([], RATES)
    for part in stored:
        every = every.unionByName(part)
    return every.groupBy("epoch", "op").agg(F.sum("n").alias("n"))


def recent_agents(lines: DataFrame, out: str, checkpoint: str, hours: int = 1) -> StreamingQuery:
    """Agents as they appear; one that is seen again within ``hours`` of its arrival is not written again.

    Arrival, not the time in the line, is what counts, so no line is late and the state store holds the agents of that time only.
    """
    arrived = parse_access(lines).where("agent_id IS NOT NULL").select("agent_id", F.current_timestamp().alias("arrived"))
    new = arrived.withWatermark("arrived", f"{hours} hours").dropDuplicatesWithinWatermark(["agent_id"])
    return (new.select("agent_id").writeStream.option("checkpointLocation", checkpoint)
            .format("parquet").option("path", out).trigger(availableNow=True).start())
