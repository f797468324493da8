import time

from opslens.operators import keyed_sum
from opslens.streaming import jobs

LINE = "2014-06-05T14:25:{:02d}.100+0000 [conn5] insert a.b ninserted:1 0ms"


def add_file(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n")
    time.sleep(1.1)


def rates(spark, out):
    start = 1401978300
    return {r.epoch - start: r.n for r in jobs.read_rates(spark, out).collect()}


def test_no_line_is_late(spark, tmp_path):
    source = tmp_path / "in"
    add_file(source, "1.log", [LINE.format(s) for s in (40, 41)])
    add_file(source, "2.log", [LINE.format(s) for s in (10, 10, 11)])
    add_file(source, "3.log", [LINE.format(s) for s in (12, 35, 40)])
    lines = jobs.follow_lines(spark, str(source), files_per_batch=1)
    jobs.ops_per_second_stream(lines, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rates(spark, str(tmp_path / "out")) == {10: 2, 11: 1, 12: 1, 35: 1, 40: 2, 41: 1}


def test_rates_go_on_after_a_restart(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: jobs.ops_per_second_stream(jobs.follow_lines(spark, str(source)), out, checkpoint).awaitTermination()
    add_file(source, "1.log", [LINE.format(s) for s in (10, 10, 11)])
    run()
    add_file(source, "2.log", [LINE.format(s) for s in (11, 12)])
    run()
    assert rates(spark, out) == {10: 2, 11: 2, 12: 1}


def test_totals_merge_by_batch(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "uid BIGINT, amount BIGINT"
    run = lambda: jobs.totals_stream(spark.readStream.schema(schema).parquet(source), "uid", "amount", out, checkpoint)
    for rows in ([(1, 5), (2, 6), (1, 1)], [(1, 10), (3, 4)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        run().awaitTermination()
    assert {r._id: r.value for r in keyed_sum.StoredTotals(spark, out).read().collect()} == {1: 16, 2: 6, 3: 4}


def test_agents_appear_once(spark, tmp_path):
    source = tmp_path / "in"
    line = '10.0.0.1 - - [11/Jun/2014:05:10:{:02d} +0000] "POST /ping/v1/{} HTTP/1.1" 200 12 "-" "Go"'
    add_file(source, "1.log", [line.format(1, "a"), line.format(2, "b"), line.format(3, "a")])
    add_file(source, "2.log", [line.format(4, "a"), line.format(5, "c")])
    out = str(tmp_path / "out")
    lines = jobs.follow_lines(spark, str(source), files_per_batch=1)
    jobs.agents_stream(lines, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.agent_id for r in jobs.read_agents(spark, out).collect()) == ["a", "b", "c"]
