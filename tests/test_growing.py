"""Logs that grow, byte ranges, prefixes, and the streams that follow them."""
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from opslens.sources import growing
from opslens.sources.lines import CHUNK_BITS, log_lines
from opslens.streaming import jobs

LINE = "2014-06-05T14:25:{:02d}.100+0000 [conn5] insert a.b ninserted:1 0ms"
START = 1401978300


def follow(spark, folder, out, checkpoint, range_bytes=1 << 20):
    """One run over what is there; the lines seen so far."""
    lines = growing.follow_growing(spark, str(folder), "*.log", range_bytes)
    (lines.writeStream.option("checkpointLocation", str(checkpoint)).format("parquet").option("path", str(out))
     .trigger(availableNow=True).start().awaitTermination())
    return sorted(r["value"] for r in spark.read.parquet(str(out)).collect())


def test_lines_added_to_a_file_are_seen_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    log = folder / "a.log"
    log.write_text("one\ntwo\nthr")
    assert follow(spark, folder, out, checkpoint) == ["one", "two"]
    with log.open("a") as f:
        f.write("ee\nfour\n")
    (folder / "b.log").write_text("new file\r\n\nlast")
    (folder / "other.txt").write_text("not wanted\n")
    assert follow(spark, folder, out, checkpoint) == sorted(["one", "two", "three", "four", "new file", ""])
    assert follow(spark, folder, out, checkpoint) == sorted(["one", "two", "three", "four", "new file", ""])


def test_truncated_rewritten_and_renamed_files(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    log = folder / "a.log"
    log.write_text("x1\nx2\nx3\n")
    follow(spark, folder, out, checkpoint)
    log.rename(folder / "a.1.log")  # rotation: the old file goes on under its new name
    with (folder / "a.1.log").open("a") as f:
        f.write("x4\n")
    log.write_text("y1\n")
    assert follow(spark, folder, out, checkpoint) == ["x1", "x2", "x3", "x4", "y1"]
    log.write_text("")  # cut short, then written anew
    assert follow(spark, folder, out, checkpoint) == ["x1", "x2", "x3", "x4", "y1"]
    log.write_text("z1\nz2\nz3\n")
    assert follow(spark, folder, out, checkpoint) == ["x1", "x2", "x3", "x4", "y1", "z1", "z2", "z3"]


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_ranges_hold_every_line_once(size):
    rng = random.Random(size)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    raw = "\n".join(["skipped", *lines, ""]).encode()
    start, end = {"f": {"to": 8, "head": raw[:8].hex()}}, {"f": {"to": len(raw), "head": raw[:256].hex()}}
    found = [line for _, first, a, b in growing.ranges(start, end, size) for line in growing.lines_between(io.BytesIO(raw), first, a, b)]
    assert [line.decode() for _, line in found] == lines
    assert [raw[at:at + len(line)] for at, line in found] == [line for _, line in found]


def test_long_lines_across_blocks(monkeypatch):
    monkeypatch.setattr(growing, "BLOCK_BYTES", 16)
    raw = b"a" * 100 + b"\n" + b"b" * 5 + b"\n" + b"c" * 50 + b"\nunfinished" + b"d" * 40
    assert growing.finished(io.BytesIO(raw), len(raw)) == 158
    assert growing.finished(io.BytesIO(b"no end" * 20), 120) == 0
    for size in (10, 33, 200):
        got = [line for at in range(0, 158, size) for line in growing.lines_between(io.BytesIO(raw), 0, at, min(at + size, 158))]
        assert got == [(0, b"a" * 100), (101, b"b" * 5), (107, b"c" * 50)]


def test_prefix_opens_only_what_it_needs(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"part-{k:02}").write_text("".join(f"{k}.{i}\n" for i in range(10)))
    (tmp_path / "part-99").mkdir()
    lines = growing.prefix_lines(spark, str(tmp_path), 25, "part-*")
    assert [r["value"] for r in lines.orderBy("file", "pos").collect()] == [f"{k}.{i}" for k in range(3) for i in range(10)][:25]
    assert lines.rdd.getNumPartitions() == 3
    assert growing.prefix_lines(spark, str(tmp_path), 10**6, "part-*").count() == 120
    assert growing.prefix_lines(spark, str(tmp_path), 0).count() == growing.prefix_lines(spark, str(tmp_path / "none"), 5).count() == 0
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"l1\nl2\nl3"))
    assert [r["value"] for r in growing.prefix_lines(spark, str(tmp_path / "z.gz"), 3).collect()] == ["l1", "l2", "l3"]


def test_compressed_log_becomes_many_chunks(spark, tmp_path):
    n = 5 * (1 << CHUNK_BITS) + 17
    (tmp_path / "big.log.gz").write_bytes(gzip.compress("".join(f"{i}\n" for i in range(n)).encode()))
    lines = log_lines(spark, str(tmp_path), spread=True)
    assert lines.select("chunk").distinct().count() == 6 and lines.groupBy("chunk").count().agg(F.max("count")).first()[0] == 1 << CHUNK_BITS
    assert [int(r["value"]) for r in lines.orderBy("chunk", "pos").collect()] == list(range(n))


def rates(spark, tmp_path):
    rows = jobs.read_windowed_rates(spark, str(tmp_path / "out"), str(tmp_path / "cp"))
    return {r["epoch"] - START: r["n"] for r in rows.collect()}


def test_windowed_rates_hold_open_seconds_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "a.log"
    run = lambda: jobs.windowed_rates(growing.follow_growing(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), delay=5)
    write = lambda seconds, mode="a": log.open(mode).write("".join(LINE.format(s) + "\n" for s in seconds))
    write([10, 10, 11], "w")
    run()
    assert rates(spark, tmp_path) == {10: 2, 11: 1}
    write([30, 31, 11])  # in time, as the first batch is the limit
    run()
    write([12, 31, 10])  # 12 and 10 are late now
    run()
    write([50])
    run()
    assert rates(spark, tmp_path) == {10: 3, 11: 2, 12: 1, 30: 1, 31: 2, 50: 1}
    late = spark.read.parquet(str(tmp_path / "out" / "late"))
    assert sorted(r["epoch"] - START for r in late.collect()) == [10, 12]
    closed = {r["epoch"] - START: r["n"] for r in spark.read.parquet(str(tmp_path / "out" / "closed")).collect()}
    still_open = {r["epoch"] - START for r in jobs.open_rates(spark, str(tmp_path / "cp")).collect()}
    assert set(closed).isdisjoint(still_open) and 50 in still_open and {10, 11} <= set(closed)
    run()  # nothing new
    assert rates(spark, tmp_path) == {10: 3, 11: 2, 12: 1, 30: 1, 31: 2, 50: 1}


def test_replayed_batch_of_windowed_rates_changes_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("".join(LINE.format(s) + "\n" for s in (1, 1, 2)))
    lines = growing.follow_growing(spark, str(folder))
    jobs._split_by_lateness(lines, str(tmp_path / "out"), str(tmp_path / "cp" / "lines"), 5).awaitTermination()
    # The driver is lost before the batch is noted as done: the same batch comes again.
    jobs._split_by_lateness(lines, str(tmp_path / "out"), str(tmp_path / "cp" / "other"), 5).awaitTermination()
    jobs._close_windows(spark, str(tmp_path / "out"), str(tmp_path / "cp" / "windows"), 5).awaitTermination()
    assert rates(spark, tmp_path) == {1: 2, 2: 1}


def test_recent_agents_are_written_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    line = '10.0.0.1 - - [11/Jun/2014:05:10:01 +0000] "POST /ping/v1/{} HTTP/1.1" 200 12 "-" "Go"\n'
    run = lambda: jobs.recent_agents(growing.follow_growing(spark, str(folder)), out, str(tmp_path / "cp")).awaitTermination()
    (folder / "a.log").write_text(line.format("a") + line.format("b") + line.format("a"))
    run()
    with (folder / "a.log").open("a") as f:
        f.write(line.format("a") + line.format("c"))
    run()
    assert sorted(r["agent_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
