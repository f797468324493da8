"""Stored partial counts, sketches, reductions of the user's own and whole run documents."""
import json
import math
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from opslens.operators import keyed_sum, user_reduce, workload
from opslens.session import scratch_dir
from opslens.sinks import report, rollups
from opslens.sources import dblog

LOG = ["2014-06-0{}T14:25:1{}.100+0000 [conn5] insert a.b ninserted:1 0ms", "2014-06-0{}T14:25:1{}.100+0000 [conn5] command a.$cmd command: isMaster {{ isMaster: 1 }} 0ms",
       "not an operation at all {} {}"]


def events(lines, name, days):
    texts = [LOG[(d + s) % 3].format(d, s) for d in days for s in range(9)]
    return dblog.parse_dblog(lines({name: texts}))


def test_loading_twice_changes_nothing(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    for name, days in (("a", [5, 6]), ("b", [6]), ("a", [5, 6]), ("a", [5])):
        rollups.load_events(events(lines, name, days), path, name)
    whole = events(lines, "a", [5]).unionAll(events(lines, "b", [6]))
    as_set = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert as_set(rollups.rates(spark, path)) == as_set(workload.ops_per_second(dblog.parsed_or_failed(whole)))
    assert as_set(rollups.kind_counts(spark, path, "ns", "op_read")) == as_set(workload.ns_load(whole))
    assert as_set(rollups.kind_counts(spark, path, rollups.database())) == as_set(workload.db_counts(whole))
    assert rollups.kind_counts(spark, path, "op", first_day="2014-06-06").agg(F.sum("n")).first()[0] == 6
    assert rollups.loaded_events(spark, path).count() == 12 and rollups.loaded_events(spark, path, "a.b").count() == rollups.loaded_events(spark, path).where("op = 'insert'").count()


def test_partial_counts_answer_without_events(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    rollups.load_events(events(lines, "a", [5]), path, "a")
    files = rollups.kind_counts(spark, path, "ns").inputFiles() + rollups.rates(spark, path).inputFiles()
    assert files and all("/kinds/" in f or "/seconds/" in f for f in files)


def test_sketches_merge_over_days_and_loads(spark, tmp_path):
    path = str(tmp_path / "sketches")
    for load, (low, high) in enumerate([(0, 6000), (4000, 9000), (0, 6000)]):
        rows = spark.range(low, high).select((F.col("id") % 3).alias("d"), F.concat(F.lit("agent"), F.col("id").cast("string")).alias("a"))
        rollups.write_sketches(rows, F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")), F.col("a"), path, str(min(load, 1) if load < 2 else 0))
    within = lambda got, exact: abs(got - exact) <= 3 * rollups.SKETCH_ERROR * exact
    assert within(rollups.distinct_estimate(spark, path).first()["estimate"], 9000)
    days = rollups.distinct_estimate(spark, path, "day").collect()
    assert len(days) == 3 and all(within(r["estimate"], 3000) for r in days)


ROWS = [(k, v) for k, vs in {"a": [12, 18, 30], "b": [7], "hot": list(range(6, 6000, 6)), "none": [None, None], None: [8, 12], "mixed": [None, 10, 15]}.items() for v in vs]


def expected(fn):
    out = {}
    for k, v in ROWS:
        out.setdefault(k, []).extend([] if v is None else [v])
    return {k: reduce(fn, vs) if vs else None for k, vs in out.items()}


@pytest.mark.parametrize("fn", [math.gcd, lambda a, b: a * b % 10007])
def test_python_reduce(spark, monkeypatch, fn):
    rows = random.Random(1).sample(ROWS, len(ROWS))
    df = spark.createDataFrame(rows, "k STRING, v BIGINT").repartition(7)
    got = user_reduce.reduce_by_key(df, F.col("k"), F.col("v"), fn)
    assert {r["_id"]: r["value"] for r in got.collect()} == expected(fn)


def test_python_reduce_of_structs_and_empty(spark):
    df = spark.createDataFrame([("a", (1, "x")), ("a", (5, "y")), ("b", (2, "z"))], "k STRING, v STRUCT<n: INT, s: STRING>")
    longer = lambda a, b: a if a["n"] >= b["n"] else b
    got = user_reduce.reduce_by_key(df, F.col("k"), F.col("v"), longer).collect()
    assert {r["_id"]: tuple(r["value"]) for r in got} == {"a": (5, "y"), "b": (2, "z")}
    assert user_reduce.reduce_by_key(df.limit(0), F.col("k"), F.col("v"), longer).collect() == []


def test_sql_reduce_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(user_reduce, "FAN", 8)
    df = spark.createDataFrame(ROWS, "_id STRING, value BIGINT").repartition(5)
    got = user_reduce.merge_by_key_sql(df, lambda a, b: a * b % 10007)
    assert {r["_id"]: r["value"] for r in got.collect()} == expected(lambda a, b: a * b % 10007)
    assert user_reduce.merge_by_key_sql(df.limit(0), lambda a, b: a + b).collect() == []


def test_stored_totals_of_a_users_function(spark, tmp_path):
    fold = lambda part: user_reduce.merge_by_key(part, math.gcd)
    store = keyed_sum.StoredTotals(spark, str(tmp_path / "t"), "gcd", fold)
    for batch, values in enumerate([[24, 36], [18], [18]]):
        df = spark.createDataFrame([("k", v) for v in values], "k STRING, v BIGINT")
        store.merge(user_reduce.reduce_by_key(df, F.col("k"), F.col("v"), math.gcd), min(batch, 1))
    assert [tuple(r) for r in store.read().collect()] == [("k", 6)] == [tuple(r) for r in store.compact(str(tmp_path / "c")).read().collect()]
    with pytest.raises(ValueError):
        keyed_sum.StoredTotals(spark, str(tmp_path / "t"), "gcd")


def test_run_documents_hold_every_sample_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "PAGE_SAMPLES", 3)
    reports = spark.createDataFrame([("r 1/x", "h", 2.5), ("r2", None, 1.0), ("r3", None, None)], "run STRING, harness STRING, throughput DOUBLE")
    values = [(f, 0, i, float(i) / 4) for f, n in (("r 1/x", 8), ("r2", 1), ("ghost", 2)) for i in range(n)]
    history = report.series_pages(spark.createDataFrame(values, "file STRING, chunk BIGINT, pos BIGINT, v DOUBLE").repartition(3), "v")
    stats = [(run, server, s, 100 + s, 1.5, None, 0.0, 2.0, float(s), 1e300) for run, server, n in (("r 1/x", "10.0.0.1", 7), ("r 1/x", "10.0.0.2", 2), ("r3", 's"q', 1)) for s in range(n)]
    series = spark.createDataFrame(stats, "run STRING, server STRING, sample INT, ts BIGINT, cpu DOUBLE, mem DOUBLE, kb_rd DOUBLE, kb_wr DOUBLE, cswch DOUBLE, nvcswch DOUBLE").repartition(4)
    pages = report.server_pages(series, F.col("server"), run=F.col("run"))
    processes = spark.createDataFrame([("r 1/x", "10_0_0_1", 'pro"c')], "run STRING, server STRING, process STRING")
    written = report.write_run_documents(report.document_pieces(reports, history, pages, processes), str(tmp_path / "docs")).collect()
    docs = {r["run"]: json.loads(open(r["file"]).read()) for r in written}
    assert all(len(open(r["file"], "rb").read()) == r["bytes"] for r in written) and set(docs) == {"r 1/x", "r2", "r3"}
    first = docs["r 1/x"]
    assert first["harness"] == "h" and first["History"] == [i / 4 for i in range(8)]
    assert first["server_stats"]["10_0_0_1"] == {"process ": 'pro"c', "ts": [100 + i for i in range(7)], "cpu": [1.5] * 7, "mem": [None] * 7, "kB_rd": [0.0] * 7, "kB_wr": [2.0] * 7,
                                                 "cswch": [float(i) for i in range(7)], "nvcswch": [1e300] * 7}
    assert list(first["server_stats"]) == ["10_0_0_1", "10_0_0_2"] and first["server_stats"]["10_0_0_2"]["ts"] == [100, 101]
    assert docs["r2"] == {"throughput": 1.0, "History": [0.0]}
    assert list(docs["r3"]) == ["server_stats"] and docs["r3"]["server_stats"]['s"q']["cpu"] == [1.5]


def test_cheap_questions_look_for_no_document(lines):
    parsed = dblog.parse_dblog(lines(["x"]))
    for question in (workload.op_counts, workload.ns_counts, workload.db_counts, workload.cmd_counts, workload.ops_per_second, workload.ops_per_second_by_op):
        plan = question(parsed)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract" not in plan and "aggregate(" not in plan, question.__name__
    assert "regexp_extract" in workload.query_shapes(parsed)._jdf.queryExecution().optimizedPlan().toString()


class Conf(dict):
    def contains(self, key):
        return key in self


class FakeSession:
    """What ``scratch_dir`` asks of a session, for masters that no test can start."""

    def __init__(self, master, conf, default):
        self.conf, self.sparkContext = Conf(default | conf), self
        self.master, self.getConf = master, lambda: Conf(conf)


@pytest.mark.parametrize("master, conf, base", [
    ("yarn", {"spark.checkpoint.dir": "hdfs:/shared/"}, "hdfs:/shared"), ("yarn", {"spark.sql.warehouse.dir": "hdfs:/house"}, "hdfs:/house"),
    ("local-cluster[3,2,1000]", {}, None), ("yarn", {}, None), ("local[4]", {}, "file:/driver"), ("local", {}, "file:/driver")])
def test_scratch_folders_are_never_a_default_of_the_driver_on_a_cluster(master, conf, base):
    session = FakeSession(master, conf, {"spark.sql.warehouse.dir": "file:/driver"})
    if base is None:
        with pytest.raises(ValueError):
            scratch_dir(session, "x")
    else:
        assert scratch_dir(session, "x").startswith(f"{base}/x-")
