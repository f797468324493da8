"""Run reports as nested JSON documents, and series in bounded pages."""

from __future__ import annotations

import json
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.sources.growing import located

PAGE_SAMPLES = 10_000


def server_key(server: Column) -> Column:
    """A server name that can be a document key."""
    return F.replace(server, F.lit("."), F.lit("_"))


def merge_attributes(old: Column, new: Column) -> Column:
    """Union of two maps; the new value wins."""
    return F.map_zip_with(old, new, lambda key, before, after: F.coalesce(after, before))


def run_reports(runs: DataFrame, results: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One document per run, also of a run whose capture has no result.

    ``runs``     ``run, harness, attributes`` (map of text)
    ``results``  ``run, throughput, attributes`` as read from the capture
    ``costs``    ``run, total_ops, utime, stime, run_ms, ticks_per_op`` of the server

    Interval and process series are not gathered into the document: ``series_pages`` and
    ``server_pages`` give them in pages of bounded size under the same run name.
    """
    found = results.select("run", "throughput", F.col("attributes").alias("new_attributes"))
    empty = F.create_map().cast("map<string,string>")
    joined = runs.join(found, "run", "left")
    if costs is not None:
        joined = joined.join(costs, "run", "left")
        cost = [F.col("utime"), F.col("stime"), F.col("total_ops"),
                F.col("ticks_per_op").alias("tick_per_op"), F.col("run_ms").alias("test_run_time")]
    else:
        cost = []
    attributes = merge_attributes(F.coalesce("attributes", empty), F.coalesce("new_attributes", empty))
    return joined.select(
        "run", "harness", F.col("run").alias("workload"), attributes.alias("attributes"),
        F.struct(F.struct(F.col("throughput").alias("op_throughput")).alias("all_nodes")).alias("summary"),
        *cost, "throughput")


def perf_reports(stats: DataFrame, info: DataFrame) -> DataFrame:
    """One document per benchmark and thread count of a micro-benchmark log."""
    attributes = F.create_map(F.lit("nThread"), F.col("thread").cast("string"), F.lit("CV"), F.col("cv_str"))
    return stats.join(info, "file", "left").select(
        F.col("file").alias("run"), F.lit("mongo-perf").alias("harness"), F.col("name").alias("workload"),
        "server_version", F.col("git_sha").alias("server_git_hash"), attributes.alias("attributes"),
        F.struct(F.struct(F.col("mean").alias("op_throughput")).alias("all_nodes")).alias("summary"))


def sim_reports(run: DataFrame, nodes: DataFrame) -> DataFrame:
    """One document per simulation run, with the statistics of every node.

    The nodes of one run come from a single line of its log, which bounds the group.
    """
    stats = nodes.groupBy("file", "node_no", "node").agg(
        F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("stats"))
    listed = stats.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("node_no", "node", "stats"))).alias("nodes"))
    by_name = F.transform("nodes", lambda n: F.create_map(n["node"], F.map_from_entries(n["stats"])))
    return run.join(listed, "file", "left").select(
        F.col("file").alias("run"), "harness", "workload", "server_version", "test_driver", "run_seconds",
        "run_nanos", "attributes", F.struct(by_name.alias("nodes")).alias("summary"))


def series_pages(series: DataFrame, *names: str) -> DataFrame:
    """``file, page, part`` and one ordered array per value.

    A page is one chunk of the capture, its parts have ``PAGE_SAMPLES`` points at most, so a
    chunk that is a whole compressed file is no single array.
    """
    in_chunk = Window.partitionBy("file", "chunk").orderBy("pos")
    numbered = series.withColumn("part", F.floor((F.row_number().over(in_chunk) - 1) / PAGE_SAMPLES))
    ordered = F.array_sort(F.collect_list(F.struct("pos", *names)))
    pages = numbered.groupBy("file", F.col("chunk").alias("page"), "part").agg(ordered.alias("points"))
    return pages.select("file", "page", "part", *[F.col(f"points.{n}").alias(n) for n in names])


def server_pages(series: DataFrame, server: Column, run: Column | None = None) -> DataFrame:
    """Process series as arrays per run and server, in pages of a fixed number of samples."""
    names = ["ts", "cpu", "mem", "kb_rd", "kb_wr", "cswch", "nvcswch"]
    ordered = F.array_sort(F.collect_list(F.struct("sample", *names)))
    keys = [server_key(server).alias("server"), F.floor(F.col("sample") / PAGE_SAMPLES).alias("page")]
    if run is not None:
        keys.insert(0, run.alias("run"))
    pages = series.groupBy(*keys).agg(ordered.alias("points"))
    return pages.select(*[c for c in pages.columns if c != "points"], *[F.col(f"points.{n}").alias(n) for n in names])


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def json_text(reports: DataFrame) -> DataFrame:
    return reports.select("run", F.to_json(F.struct(*[c for c in reports.columns if c != "run"])).alias("report"))


# ---------------------------------------------------------------- whole documents, series included

# Fixed values of the report format: roles of servers, and the names that series have in a document.
ROLES = ["mongod", "mongos", "config"]
SERVER_SERIES = {"ts": "ts", "cpu": "cpu", "mem": "mem", "kb_rd": "kB_rd", "kb_wr": "kB_wr", "cswch": "cswch", "nvcswch": "nvcswch"}
PROCESS = "process "
HISTORY = ["History", "HistoryResponseTime"]


def with_test_bed(reports: DataFrame, kinds: DataFrame, servers: DataFrame) -> DataFrame:
    """Adds ``testbed``: the kind of set-up of a run and its servers by role.

    ``kinds`` has ``run, type``, ``servers`` has ``run, role, server, host, build, storage_engine``.  A run has a handful of servers.
    """
    described = F.struct("server", F.col("host").alias("hostinfo"), F.col("build").alias("serverBuildInfo"), F.struct(F.col("storage_engine").alias("name")).alias("storageEngine"))
    role = lambda name: F.array_sort(F.collect_list(F.when(F.col("role") == name, described)), lambda a, b: F.when(a["server"] < b["server"], -1).when(a["server"] > b["server"], 1).otherwise(0))
    by_run = servers.groupBy("run").agg(*[role(name).alias(name) for name in ROLES])
    beds = kinds.join(by_run, "run", "left").select("run", F.struct("type", F.struct(*ROLES).alias("servers")).alias("testbed"))
    return reports.join(beds, "run", "left")


def _numbers(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ",")


def document_pieces(reports: DataFrame, history: DataFrame | None = None, servers: DataFrame | None = None, processes: DataFrame | None = None) -> DataFrame:
    """The texts that documents are made of: ``run, part, server, field, page, text``, in an order that can be sorted.

    ``history``    pages of ``series_pages`` under the run's name: ``file, page, part`` and one or two arrays
    ``servers``    pages of ``server_pages(run=...)``
    ``processes``  ``run, server, process``
    """
    empty, zero = F.lit(""), F.lit(0).cast("bigint")
    body = F.to_json(F.struct(*[c for c in reports.columns if c != "run"]))
    pieces = reports.select("run", F.lit(0).alias("part"), empty.alias("server"), empty.alias("field"), zero.alias("page"), zero.alias("nth"), body.alias("text"))
    if history is not None:
        names = [c for c in history.columns if c not in ("file", "page", "part")]
        listed = F.array(*[F.struct(F.lit(title).alias("field"), _numbers(F.col(c)).alias("text")) for title, c in zip(HISTORY, names)])
        pieces = pieces.unionAll(history.select(F.col("file").alias("run"), F.lit(1), empty, F.col("page").cast("bigint"), F.col("part").cast("bigint"), F.inline(listed)).select(
            "run", F.lit(1), empty, "field", "page", "part", "text"))
    if servers is not None:
        listed = F.array(*[F.struct(F.lit(f"{i}{title}").alias("field"), _numbers(F.col(c)).alias("text")) for i, (c, title) in enumerate(SERVER_SERIES.items(), 1)])
        pieces = pieces.unionAll(servers.select("run", "server", F.col("page").cast("bigint").alias("page"), F.inline(listed)).select(
            "run", F.lit(2), "server", "field", "page", zero, "text"))
    if processes is not None:
        pieces = pieces.unionAll(processes.select("run", F.lit(2), "server", F.lit(f"0{PROCESS}"), zero, zero, F.to_json(F.struct(F.col("process").alias("p")))))
    return pieces


class _Document:
    """One document, written piece by piece."""

    def __init__(self, out):
        self.out, self.at, self.size, self.body = out, (None, None, None), 0, False

    def write(self, text: str) -> None:
        raw = text.encode()
        self.out.write(raw)
        self.size += len(raw)

    def close_field(self, part: int | None, server: str | None) -> None:
        if self.at[2]:
            self.write("]")
        if self.at[0] == 2 and (part, server) != self.at[:2]:
            self.write("}" if part == 2 else "}}")

    def add(self, part: int, server: str, field: str, text: str) -> None:
        if part == 0:
            self.write(text[:-1])
            self.body = text != "{}"
            return
        if (part, server, field) == self.at:
            self.write("," + text)
            return
        self.close_field(part, server)
        before, self.at = self.at, (part, server, field)
        if part == 1:
            self.write(("," if self.body else "") + json.dumps(field) + ":[" + text)
            self.body = True
            return
        if before[0] != 2:
            self.write((',' if self.body else '') + '"server_stats":{')
            self.body = True
        new = (part, server) != before[:2]
        if new:
            self.write(("," if before[0] == 2 else "") + json.dumps(server) + ":{")
        name = field[1:]
        self.write("" if new else ",")
        if name == PROCESS:
            self.write(json.dumps(name) + ":" + json.dumps(json.loads(text).get("p")))
            self.at = (part, server, "")
        else:
            self.write(json.dumps(name) + ":[" + text)

    def close(self) -> int:
        self.close_field(None, None)
        self.write("}\n")
        self.out.close()
        return self.size


def write_run_documents(pieces: DataFrame, path: str) -> DataFrame:
    """Writes one JSON document for each run to ``<path>/<run>.json`` and gives ``run, file, bytes``.

    The pieces of a run come to one task in order, which writes them as they come: a document is one file, but at no
    time is more than one page of it held.  A task that is run again writes the same file again.
    """
    def work(batches):
        document, run, name, rows = None, None, None, []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("run", "part", "server", "field", "text"))):
                if document is None or row[0] != run:
                    if document is not None:
                        rows.append((run, name, document.close()))
                    run = row[0]
                    system, plain = located(f"{path}/{quote(run, safe=' ()+,=@')}.json")
                    system.create_dir(plain.rsplit("/", 1)[0])
                    name, document = plain, _Document(system.open_output_stream(plain))
                document.add(*row[1:])
        if document is not None:
            rows.append((run, name, document.close()))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["run", "file", "bytes"])

    # Series of runs without a report have no document.
    known = pieces.where("part = 0").select("run")
    order = ["run", "part", "server", "field", "page", "nth"]
    ordered = pieces.join(known, "run", "left_semi").repartition("run").sortWithinPartitions(*order)
    written = ordered.select("run", "part", "server", "field", "text").mapInArrow(work, "run string, file string, bytes long")
    return pieces.sparkSession.createDataFrame(written.collect(), written.schema)  # one row for each document
