import json

import pytest
from pyspark.sql import functions as F

from opslens.operators import changes, counters, http, keyed_sum, perf, synth
from opslens.sinks import report
from opslens.sources import access, csv_tail, oplog
from opslens.sources.lines import log_lines

ACCESS = """192.168.19.101 - - [11/Jun/2014:05:10:22 +0000] "POST /ping/v1/95620b7084cf71a6594abf82a5b4cd3d HTTP/1.1" 200 12 "-" "Go 1.0"
10.0.2.2 - - [11/Jun/2014:05:10:23 +0000] "GET / HTTP/1.1" 200 512 "-" "Mozilla/5.0"
10.0.2.2 - - [11/Jun/2014:05:10:23 +0000] "GET / HTTP/1.1" 200 512 "-" "Mozilla/5.0"
10.0.2.2 - - [30/May/2014:05:10:23 -0700] "POST /ping/v2/beef HTTP/1.1" 200 1 "-" "x"
"127.0.0.1" - - [11/Jun/2014:05:10:23 +0000] "POST
short"""


def test_access_events(lines):
    rows = access.parse_access(lines(ACCESS)).orderBy("pos").collect()
    first = rows[0]
    assert (first.ip, first.ts, first.op) == ("192.168.19.101", "11/Jun/2014:05:10:22", "POST")
    assert first.agent_id == "95620b7084cf71a6594abf82a5b4cd3d" and first.http_agent == "Go"
    assert first.http == "POST /ping/v1/95620b7084cf71a6594abf82a5b4cd3d" and first.epoch == 1402463422
    assert rows[3].epoch == 1401451823 and rows[3].agent_id == "beef" and rows[1].agent_id is None
    assert (rows[4].ip, rows[4].op, rows[4].url, rows[4].http) == ("127.0.0.1", "POST", None, "POST ")
    assert (rows[5].ip, rows[5].op, rows[5].ts, rows[5].epoch) == ("short", "", "", None)


def test_client_profiles(lines):
    events = access.parse_access(lines(ACCESS))
    pivot = {r.ip: (r.get, r.post) for r in http.client_methods(events, ["GET", "POST"]).collect()}
    assert pivot == {"192.168.19.101": (0, 1), "10.0.2.2": (2, 1), "127.0.0.1": (0, 1), "short": (0, 0)}
    assert {r.op: r.n for r in http.method_counts(events).collect()} == {"GET": 2, "POST": 3, "": 1}
    assert [r.ip for r in http.agent_clients(events).collect()] == ["192.168.19.101"]
    assert [tuple(r) for r in http.repeated_requests(events).collect()] == [("GET /", 2)]
    assert http.unique_agents(events).first().n_agents == 2
    assert http.unique_agents(events, approximate=True).first().n_agents == 2
    first = http.requests_per_second(events, http.of_client("10.0.2.2"), first=1).collect()
    assert [(r.ts, r.n) for r in first] == [("30/May/2014:05:10:23", 1)], "sorted by time, not by text"


def test_read_access(spark, tmp_path):
    (tmp_path / "a.log").write_text(ACCESS)
    assert access.read_access(spark, str(tmp_path)).count() == 6
    assert log_lines(spark, [str(tmp_path / "a.log")]).count() == 6


def test_oplog(lines):
    texts = ['{"ts": 1, "op": "i", "ns": "a.b", "o": {"_id": "x", "i": 1, "g": "p"}}',
             '{"ts": 2, "op": "i", "ns": "a.b", "o": {"_id": "y", "i": 1, "g": "p", "more": {"z": [1]}}}',
             '{"ts": 3, "op": "i", "ns": "a.b", "o": {"_id": "z"}}', '{"ts": 4, "op": "u", "ns": "a.b", "o": {"i": 2}}',
             '{"ts": 5, "op": "i", "ns": "c.d", "o": {"i": 3, "g": "q"}}', "not json"]
    rows = oplog.parse_oplog(lines(texts))
    assert json.loads(rows.where("doc_id = 'y'").first().doc)["more"] == {"z": [1]}
    assert changes.distinct_groups(rows, "a.b").first().n_groups == 2
    assert rows.where(changes.is_update()).count() == 1 and rows.where(changes.is_insert()).count() == 4
    assert {r.ns: r.n for r in changes.ns_counts(rows).collect()} == {"a.b": 4, "c.d": 1, None: 1}


PROFILE = {1400793963: {"update": 701}, 1400793964: {"update": 349}, 1400793965: {"update": 274},
           1400793966: {"query": 1}, 1400793973: {"query": 398}, 1400793974: {"query": 177},
           1400793980: {"query": 4, "command": 3}}


def test_profile_rates(spark, tmp_path):
    records = [(second, op) for second, ops in PROFILE.items() for op, n in ops.items() for _ in range(n)]
    table = spark.createDataFrame(records, "s BIGINT, op STRING").select(F.timestamp_seconds("s").alias("ts"), "op")
    table.write.json(str(tmp_path / "profile"))
    read = oplog.read_profile(spark, str(tmp_path / "profile"))
    rates = {r.epoch: r for r in changes.profile_ops_per_second(read).collect()}
    assert {s: r.all_ops for s, r in rates.items()} == {s: sum(ops.values()) for s, ops in PROFILE.items()}
    assert rates[1400793980].query_ops == 4 and rates[1400793963].update_ops == 701


def test_keyed_sums(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 1)], "uid BIGINT, amount BIGINT")
    single = keyed_sum.keyed_reduce(rows, F.col("uid"), F.col("amount"))
    assert {r._id: r.value for r in single.collect()} == {1: 11, 2: 7, None: 1}
    assert {r._id: r.value for r in keyed_sum.keyed_reduce(rows, F.col("uid"), F.col("amount"), F.max).collect()}[1] == 6
    eight = keyed_sum.merge_totals(*[single] * 8)
    known = single.where("_id IS NOT NULL")
    assert keyed_sum.check_totals(known, eight.where("_id IS NOT NULL"), 8).count() == 0
    wrong = eight.where("_id = 1").withColumn("value", F.col("value") + 1)
    assert {tuple(r) for r in keyed_sum.check_totals(known, wrong, 8).collect()} == {(1, 11, 89), (2, 7, None)}


def test_stored_totals_survive_replay(spark, tmp_path):
    store = keyed_sum.StoredTotals(spark, str(tmp_path / "totals"))
    part = lambda *pairs: spark.createDataFrame(pairs, "_id BIGINT, value BIGINT")
    store.merge(part((1, 5), (2, 1)), 0)
    store.merge(part((1, 7)), 1)
    store.merge(part((1, 7)), 1)
    want = {1: 12, 2: 1}
    assert {r._id: r.value for r in store.read().collect()} == want
    compacted = store.compact(str(tmp_path / "compacted"))
    assert {r._id: r.value for r in compacted.read().collect()} == want
    compacted.merge(part((3, 9)), 0)
    assert {r._id: r.value for r in compacted.read().collect()} == {**want, 3: 9}


def test_jobs_share_a_store_and_reducers_do_not(spark, tmp_path):
    part = lambda *pairs: spark.createDataFrame(pairs, "_id BIGINT, value BIGINT")
    store = keyed_sum.StoredTotals(spark, str(tmp_path / "max"), reducer="max")
    store.merge(part((1, 5)), 0, job="a")
    store.merge(part((1, 9), (2, 1)), 0, job="b")
    assert {r._id: r.value for r in store.read().collect()} == {1: 9, 2: 1}
    assert {r._id: r.value for r in store.compact(str(tmp_path / "less")).read().collect()} == {1: 9, 2: 1}
    with pytest.raises(ValueError, match="max, not of sum"):
        keyed_sum.StoredTotals(spark, store.path).read()
    with pytest.raises(ValueError, match="avg cannot be merged"):
        keyed_sum.StoredTotals(spark, store.path, reducer="avg")


def test_no_samples_have_no_cv(spark):
    samples = spark.createDataFrame([("f", "A", 1, None), ("f", "B", 1, 2.0)], "file STRING, name STRING, thread INT, result DOUBLE")
    got = {r.name: (r.n, r.cv_str) for r in perf.mean_cv(samples).collect()}
    assert got == {"A": (0, perf.NO_SAMPLES), "B": (1, "n/a")}


def test_blank_lines_are_no_csv_rows(lines):
    (row,) = csv_tail.csv_tail_summary(lines(["", "h", "1", " ", "2", "3", "", ""])).collect()
    assert (row.header, row.last_row, row.missing) == ("h", "2", False)


COUNTERS = {"insert": 30482408, "query": 71843659, "update": 44281266, "delete": 0, "getmore": 5904187, "command": 1438082}


def shell(value):
    body = json.dumps(value, indent=8).replace('": ', '" : ')
    return "MongoDB shell version: 2.6.3\nconnecting to: test\nserverBuildInfo\n" + body


def test_run_costs(spark):
    after = {name: n + i for i, (name, n) in enumerate(COUNTERS.items())}
    proc = "17 (mongod) S 1 17 17 0 -1 4202752 100 0 5 0 %d %d 0 0 20 0 25 0 1000"
    rows = [("r", "before", 1000, shell(COUNTERS), proc % (10, 20)),
            ("r", "after", 4000, shell({"opcounters": after, "other": {"insert": 5}}), proc % (40, 30)),
            ("idle", "before", 0, shell(COUNTERS), proc % (1, 1)), ("idle", "after", 5, shell(COUNTERS), proc % (2, 1))]
    snapshots = spark.createDataFrame(rows, "run STRING, phase STRING, time_ms BIGINT, counters_text STRING, proc_text STRING")
    costs = {r.run: r for r in counters.run_costs(counters.parse_snapshots(snapshots)).collect()}
    assert (costs["r"].total_ops, costs["r"].utime, costs["r"].stime, costs["r"].run_ms) == (15, 30, 10, 3000)
    assert abs(costs["r"].ticks_per_op - 40 / 15) < 1e-12 and costs["idle"].ticks_per_op is None


def test_documents_from_shapes(spark):
    docs = synth.gen_docs(spark, {"a": 100, "b": {"b1": 100, "b2": 100}}, 20, 10).orderBy("_id").collect()
    assert len(docs) == 20 and docs[0].asDict(recursive=True) == {"_id": 10, "a": 10, "b": {"b1": 10, "b2": 10}}
    shape = synth.schema_of({"cid": "ObjectId", "cre": "rand-int lte", "status": "string"})
    assert shape == {"cid": "ObjectId", "cre": ["rand-int", "lte"], "status": "string"}
    row = synth.gen_docs(spark, shape, 10, 10).orderBy("_id").first()
    assert (row.cid, row.status) == ("ObjectId(10)", "string_10") and 0 <= row.cre < 1000
    bound = synth.gen_docs(spark, shape, 1, 10, query=True).first()
    assert 0 <= bound.cre["$lte"] < 1000
    other = synth.gen_docs(spark, {"x": ["rand"], "y": ["z"]}, 50).collect()
    assert all(0 <= r.x < 1000 and r.y == 10001 for r in other) and len({r.x for r in other}) > 40
    assert synth.index_of({"a": "int", "b": {"c": "string"}}) == {"a": 1, "b.c": 1}


def test_staging_rows(spark):
    rows = synth.gen_staging(spark, 20, statuses=5, writers=10)
    assert rows.count() == 20 * 5 * 10 and rows.select("uid", "writer", "status").distinct().count() == 1000
    assert rows.where("amount < 0 OR amount >= 1000000").count() == 0
    again = synth.gen_staging(spark, 20, statuses=5, writers=10)
    assert rows.exceptAll(again).count() == 0


def test_run_reports(spark, tmp_path):
    maps = lambda text: F.from_json(F.lit(text), "MAP<STRING, STRING>")
    runs = spark.range(1).select(F.lit("r1").alias("run"), F.lit("sysbench").alias("harness"),
                                 maps('{"run-by": "me", "nThreads": "?"}').alias("attributes"))
    results = spark.range(1).select(F.lit("r1").alias("run"), F.lit(741.86).alias("throughput"),
                                    maps('{"nThreads": "64"}').alias("attributes"))
    costs = spark.createDataFrame([("r1", 100, 5, 6, 7000, 0.11)], "run STRING, total_ops BIGINT, utime BIGINT, "
                                  "stime BIGINT, run_ms BIGINT, ticks_per_op DOUBLE")
    report.write_reports(report.run_reports(runs, results, costs), str(tmp_path / "out"))
    (text,) = [line for path in (tmp_path / "out").glob("part-*") for line in path.read_text().splitlines()]
    got = json.loads(text)
    assert got["attributes"] == {"run-by": "me", "nThreads": "64"}
    assert got["summary"]["all_nodes"]["op_throughput"] == 741.86 and got["tick_per_op"] == 0.11
    assert json.loads(report.json_text(report.run_reports(runs, results)).first().report)["workload"] == "r1"


def test_series_pages(spark):
    series = spark.createDataFrame([("a.b", 2 * (i // 4), i, float(i), i * 10.0) for i in range(10)],
                                   "file STRING, chunk BIGINT, pos BIGINT, cum DOUBLE, interval DOUBLE")
    pages = report.series_pages(series.repartition(5), "cum", "interval").orderBy("page").collect()
    assert [r.cum for r in pages] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and pages[1].interval == [40, 50, 60, 70]
    names = ("ts", "cpu", "mem", "kb_rd", "kb_wr", "cswch", "nvcswch")
    points = series.select("file", F.col("pos").cast("int").alias("sample"), *[F.col("cum").alias(n) for n in names])
    (page,) = report.server_pages(points, F.col("file")).collect()
    assert page.server == "a_b" and page.cpu == [float(i) for i in range(10)]


def test_perf_and_simulation_reports(spark):
    stats = spark.createDataFrame([("f", "A", 5, 1.5, "n/a")], "file STRING, name STRING, thread INT, mean DOUBLE, cv_str STRING")
    info = spark.createDataFrame([("f", "2.7.5", "abc")], "file STRING, server_version STRING, git_sha STRING")
    row = report.perf_reports(stats, info).first()
    assert (row.workload, row.server_version, row.attributes) == ("A", "2.7.5", {"nThread": "5", "CV": "n/a"})
    nodes = spark.createDataFrame([("f", 1, "b", "m", 2.0), ("f", 0, "a", "m", 1.0), ("f", 0, "a", "k", 3.0)],
                                  "file STRING, node_no INT, node STRING, metric STRING, value DOUBLE")
    run = spark.createDataFrame([("f", "mongo-sim", "w", "2", None, 1, 2, {"x": "y"})],
                                "file STRING, harness STRING, workload STRING, server_version STRING, test_driver STRING, "
                                "run_seconds BIGINT, run_nanos BIGINT, attributes MAP<STRING, STRING>")
    got = report.sim_reports(run, nodes).first()
    assert got.summary.nodes == [{"a": {"k": 3.0, "m": 1.0}}, {"b": {"m": 2.0}}]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from opslens import session
    assert session.scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key: None)}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster, "x")
