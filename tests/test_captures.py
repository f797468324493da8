import json
import random

import pytest
from pyspark.sql import functions as F

from opslens.sources import captures, csv_tail, pidstat, shell_json
from opslens.sources.lines import documents, first_lines, log_lines

# Fixed values of the capture formats: the names of settings and the words of interval and result lines.  Numbers are our own, but
# for the cumulative results that have to come out (12445.96, 9567.0, 58782.55...).
OLTP = ["range size", "point selects", "simple ranges", "sum ranges", "order ranges", "distinct ranges", "index updates", "non index updates"]
SETTINGS = {"collections": "21", "database name": "depot", "writer threads": "48", "documents per collection": "3,500,000", "feedback seconds": "5", "run seconds": "90",
            **{f"oltp {name}": str(31 + i) for i, name in enumerate(OLTP)}, "write concern": "SAFE"}
SETTING = "Thread[main,5,main]  {:<24} = {}"
INTERVAL = "Thread[Thread-3,5,main]{} seconds : cum tps={} : int tps={} : cum ips=0.00 : int ips=0.00"
SYSBENCH = "\n".join([*[SETTING.format(*pair) for pair in SETTINGS.items()], INTERVAL.format(5, "610.50", "610.50"), INTERVAL.format(10, "2,640.25", "715.75"), "Thread[main,5,main]Done!"])


def test_sysbench(lines):
    table = lines(SYSBENCH)
    row = captures.summary(table, "sysbench", strict=True).first()
    assert (row.throughput, row.n_intervals, row.nThreads, row.nCollectionSize) == (2640.25, 2, "48", "3,500,000")
    assert row["oltp non index updates"] == "38" and row["write concern"] == "SAFE"
    series = captures.intervals(table, "sysbench").orderBy("chunk", "pos").collect()
    assert [(r.cum, r.interval) for r in series] == [(610.5, 610.5), (2640.25, 715.75)]


def test_parameter_status(lines):
    text = SYSBENCH.replace(SETTING.format("run seconds", "90") + "\n", "")
    text += "\n" + SETTING.format("writer threads", "48")
    status = {r.param: (r.status, r.matches) for r in captures.parameters(lines(text), "sysbench").collect()}
    assert status["nRunSeconds"] == ("missing", 0) and status["nThreads"] == ("ambiguous", 2)
    assert sum(s == "ok" for s, _ in status.values()) == 12
    assert {r.value for r in captures.parameters(lines(text), "sysbench").where("status <> 'ok'").collect()} == {None}
    row = captures.summary(lines(text), "sysbench").first()
    assert (row.nThreads, row.nRunSeconds, row.status) == (None, None, "nThreads ambiguous, nRunSeconds missing")
    with pytest.raises(Exception, match="missing|ambiguous"):
        captures.parameters(lines(text), "sysbench", strict=True).collect()


def test_sysbench_insert(lines):
    table = lines("""  22 collections
  6 writer thread(s)
  700,000 documents per collection
  Feedback every 15 seconds(s)
  Feedback every -1 inserts(s)
  write concern = SAFE
Thread[Thread-4,5,main]30,000 inserts : 15 seconds : cum ips=20,000.25 : int ips=20,000.25
Thread[Thread-4,5,main]91,000 inserts : 30 seconds : cum ips=12,445.96 : int ips=4,066.75""")
    row = captures.summary(table, "sysbench-insert", strict=True).first()
    assert (row.throughput, row.nThreads, row.nCollections, row.nFeedbackSeconds) == (12445.96, "6", "22", "15")


HAMMER = """Mar 02 07:15:40  Total send:  4100  | Last avg(ms):  0.250125  send:  4100  | conn: 6
Mar 02 07:16:40  Total send:  9350  | Last avg(ms):  0.375500  send:  5250  | conn: 6
Final results:
                                   ack/s : 9567.500000
                                 avg(ms) : 0.312750
                            err ratio(%) : 2.50
                           slow ratio(%) : 7.25
                            last avg(ms) : 0.375500
                                    conn : 6"""


def test_hammer(lines):
    row = captures.summary(lines(HAMMER), "hammer", strict=True).first()
    assert (row.throughput, row.nThreads, row.avgResponseTime, row.errorRatio, row.slowRatio) == (
        9567.0, "6", "0.312750", "2.50", "7.25")
    series = captures.intervals(lines(HAMMER), "hammer").orderBy("pos").collect()
    assert [(r.avg, r.send) for r in series] == [(0.250125, 4100.0), (0.3755, 5250.0)]


YCSB = ["start", "Command line: -db one", "Command line: -db two -threads 64 -t", "[OVERALL], RunTime(ms), 17",
        "[OVERALL], Throughput(ops/sec), 58782.55451347149", "Command line: late", "[OVERALL], Throughput(ops/sec), 1.0"]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_ycsb(lines, chunk):
    table = lines({"full": YCSB, "bare": YCSB[4:5], "empty": ["x"]}, chunk=chunk)
    rows = {r.file: (r.throughput, r.command_line) for r in captures.ycsb_summary(table).collect()}
    assert rows == {"full": (58782.55451347149, "Command line: -db two -threads 64 -t"), "bare": (58782.55451347149, None), "empty": (None, None)}
    with pytest.raises(Exception, match="empty has no result"):
        captures.ycsb_summary(table, strict=True).collect()
    (late,) = captures.ycsb_summary(lines(YCSB[:3], chunk=chunk)).collect()
    assert (late.throughput, late.command_line) == (None, YCSB[2])


def sim_json(attributes):
    return json.dumps({
        "harness": "mongo-sim", "workload": "depot", "server_version": "9.1.0", "run_seconds": 8, "run_nanos": 125,
        "attributes": attributes, "test_driver": {"version": "4.4.0", "git_hash": "c0de", "build_date": "1700000000"},
        "summary": {"all_nodes": {}, "nodes": [{"arrive": {"op_count": 7, "op_lat_total_micros": 64}},
                                               {"leave": {"op_count": 90}, "ask": {"op_throughput": 1.5}}]}})


def test_simulation(lines):
    mark = "==== perf metrics ===="
    listed = ["noise", mark, '{"harness": "old"}', mark, sim_json([{"nThreads": 5}, {"nSteps": 1000}]), "bye"]
    table = lines({"list": listed, "map": [mark, sim_json({"nThreads": 9})], "none": ["x"]}, chunk=2)
    runs = {r.file: r for r in captures.sim_run(table).collect()}
    assert set(runs) == {"list", "map", "none"} and runs["none"].workload is None and runs["none"].attributes is None
    assert runs["list"].attributes == {"nThreads": "5", "nSteps": "1000"} and runs["map"].attributes == {"nThreads": "9"}
    assert (runs["list"].workload, runs["list"].run_nanos, runs["list"].test_driver.git_hash) == ("depot", 125, "c0de")
    stats = {(r.node_no, r.node, r.metric): r.value for r in captures.sim_node_stats(table).where("file = 'list'").collect()}
    assert stats == {(0, "arrive", "op_count"): 7, (0, "arrive", "op_lat_total_micros"): 64,
                     (1, "leave", "op_count"): 90, (1, "ask", "op_throughput"): 1.5}


HEADER_1 = "#      Time      TGID       TID    %usr %system  %guest    %CPU   CPU   %MEM   kB_rd/s   kB_wr/s   cswch/s nvcswch/s  Command"
HEADER_2 = "#      Time      TGID       TID    %usr %system  %guest    %CPU   CPU   kB_rd/s   kB_wr/s   %MEM   cswch/s nvcswch/s  Command"


def capture(header, blocks, rng):
    """A capture and the kept samples it holds."""
    swapped = header is HEADER_2
    texts, want = ["Linux 2.6.32", ""], []
    for m in range(1, blocks + 1):
        cpu, mem, rd, wr = (round(rng.uniform(0, 99), 2) for _ in range(4))
        middle = (rd, wr, mem) if swapped else (mem, rd, wr)
        row = lambda tid, cs, ncs, name: f" {1000 + m}  17  {tid}  1.00 0.50 0.00 {cpu}  3  " + "  ".join(
            str(v) for v in middle) + f"  {cs}  {ncs}  {name}"
        switches = [(rng.randint(0, 999), rng.randint(0, 99)) for _ in range(rng.randint(0, 4))]
        texts += [header, row(0, 0, 0, "mongod")] + [row(20 + i, c, n, "|__mongod") for i, (c, n) in enumerate(switches)] + [""]
        if 10 <= m < blocks - 10:
            want.append((m, 1000 + m, cpu, mem, rd, wr, float(sum(c for c, _ in switches)), float(sum(n for _, n in switches))))
    return texts, want


@pytest.mark.parametrize("chunk", [4, 1000])
def test_pidstat_layouts(lines, chunk):
    rng = random.Random(3)
    made = {"a": capture(HEADER_1, 40, rng), "b": capture(HEADER_2, 25, rng), "short": capture(HEADER_1, 20, rng)}
    table = lines({name: texts for name, (texts, _) in made.items()}, chunk=chunk)
    got = {}
    for r in pidstat.pidstat_series(table).orderBy("file", "sample").collect():
        got.setdefault(r.file, []).append((r["sample"], r.ts, r.cpu, r.mem, r.kb_rd, r.kb_wr, r.cswch, r.nvcswch))
    assert got == {name: want for name, (_, want) in made.items() if want}
    assert {tuple(r) for r in pidstat.pidstat_process(table).collect()} == {("a", "mongod"), ("b", "mongod")}


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_csv_tail(spark, lines, chunk):
    table = lines({"a": ["h,k", "1,2", "3,4", "5,6"], "b": ["x,y", "1,1"], "c": ["only"], "d": ["h", "1", "2"]}, chunk=chunk)
    expected = spark.createDataFrame([(f,) for f in "abcde"], "file STRING")
    rows = {r.file: (r.header, r.last_row, r.missing) for r in csv_tail.csv_tail_summary(table, expected).collect()}
    assert rows == {"a": ("h,k", "3,4", False), "b": ("x,y", None, False), "c": ("only", None, False),
                    "d": ("h", "1", False), "e": (None, None, True)}


def shell(body):
    return "shell version: 9.1\nconnecting to: nowhere\nthird line of the banner\n" + body


# Fixed values of the format: the names, and how dates and long numbers are written.  The host is our own.
HOST = shell('{\n\t"system" : {\n\t\t"currentTime" : ISODate("2020-02-02T02:02:02.002Z"),\n\t\t"hostname" : "gate-3",\n'
             '\t\t"memSizeMB" : 20480,\n\t\t"numCores" : 6,\n\t\t"numaEnabled" : false\n\t},\n\t"extra" : {\n'
             '\t\t"pageSize" : NumberLong(8192),\n\t\t"maxOpenFiles" : 512\n\t},\n\t"ok" : 1\n}')
BUILD = shell('{\n\t"version" : "9.1.0",\n\t"bits" : 64,\n\t"debug" : true\n}')


def test_server_info(spark):
    rows = [("a", HOST, BUILD, shell("undefined")), ("b", HOST, BUILD, shell('{ "name" : "wiredTiger" }'))]
    texts = spark.createDataFrame(rows, "server STRING, host_text STRING, build_text STRING, engine_text STRING")
    a, b = shell_json.parse_server_info(texts).orderBy("server").collect()
    assert (a.host.system.memSizeMB, a.host.system.numCores, a.host.extra.pageSize) == (20480, 6, 8192)
    assert (a.build.version, a.build.bits, a.build.debug) == ("9.1.0", 64, True)
    assert (a.storage_engine, b.storage_engine) == ("mmapv0", "wiredTiger")


def test_text_files_keep_line_order(spark, tmp_path):
    rng = random.Random(1)
    names = [f"Name.{i}" for i in range(400)]
    text, want = [], {}
    for name in names:
        values = [rng.randint(1, 10 ** 6) for _ in range(rng.randint(1, 30))]
        want[name] = values
        text += [name] + [f"1\t{v}" for v in values]
    (tmp_path / "a.log").write_text("\n".join(text) + "\n")
    (tmp_path / "b.log").write_text("Other\n3\t4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        from opslens.sources.perf_log import perf_samples
        table = log_lines(spark, str(tmp_path))
        assert table.select("chunk").distinct().count() > 5
        samples = perf_samples(table).where("name <> 'Other'").orderBy("chunk", "pos").collect()
        assert [(r.name, int(r.result)) for r in samples] == [(n, v) for n in names for v in want[n]]
        prefix = first_lines(table, 100).where(F.col("file").endswith("a.log")).orderBy("chunk", "pos").collect()
        assert [r.value for r in prefix] == text[:100]
        assert first_lines(table, 100).where(F.col("file").endswith("b.log")).count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_documents(spark, tmp_path):
    (tmp_path / "host.txt").write_text(HOST)
    (row,) = documents(spark, str(tmp_path)).select(shell_json.cleaned(F.col("text")).alias("t")).collect()
    assert json.loads(row.t)["extra"] == {"pageSize": 8192, "maxOpenFiles": 512}
