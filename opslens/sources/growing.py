"""Logs that grow: a data source that reads text files by byte ranges.

As a stream it remembers a byte position for each file and hands on the lines that were finished since.  A last line without
its line end is kept back until it is finished.  A file that was cut short or written anew (its first bytes changed) is read
from its start; one that was renamed, as log rotation does, goes on where it was under its old name.

As a batch it reads the first lines of given files and opens no byte behind them, compressed files included.

Lines have the columns ``file, chunk, pos, value``: ``chunk`` is where the byte range begins that a task reads, ``pos`` the place of the
line's first byte, so (chunk, pos) is the line order of the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, chunk bigint, pos bigint, value string"
COLUMNS = ["file", "chunk", "pos", "value"]
#: Bytes that one task reads, and bytes that are read at once.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
#: First bytes by which a file is known again.
HEAD_BYTES = 256


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path as Spark writes it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """Name and size of the files of a folder (or of the one file ``path``), by name; hidden ones are left out."""
    system, plain = located(path)
    info = system.get_file_info(plain)
    if info.type == fs.FileType.File:
        return [(plain, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    found = system.get_file_info(fs.FileSelector(plain))
    wanted = [f for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in wanted)


def finished(handle, size: int) -> int:
    """Where the last finished line ends, looked for from the end of the file."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK_BYTES)
        handle.seek(start)
        at = handle.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def ranges(start: dict, end: dict, size: int) -> list[tuple[str, int, int, int]]:
    """(file, first, from, to): byte ranges between two offsets; ``first`` is where the new part of the file begins.

    Depends on the offsets alone, so a batch that is replayed reads the same.
    """
    goes_on = lambda before, now: before["to"] <= now["to"] and now["head"].startswith(before["head"])
    same = {name for name, now in end.items() if name in start and goes_on(start[name], now)}
    moved = [before for name, before in start.items() if name not in same and before["head"]]
    out = []
    for name, now in end.items():
        first = start[name]["to"] if name in same else max((b["to"] for b in moved if goes_on(b, now)), default=0)
        out += [(name, first, at, min(at + size, now["to"])) for at in range(first, now["to"], size)]
    return out


def lines_between(handle, first: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in ``start .. end - 1``; a line begins at ``first`` and after every line end."""
    at = start
    if start > first:
        handle.seek(start - 1)
        at = start - 1
        while True:
            block = handle.read(BLOCK_BYTES)
            if not block:
                return
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(block)
    handle.seek(at)
    rest = b""
    while at < end:
        block = handle.read(BLOCK_BYTES)
        if not block:
            return
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1


def batches(name: str, chunk: int, lines: Iterator[tuple[int, bytes]], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    places: list[int] = []
    texts: list[str] = []

    def batch() -> pa.RecordBatch:
        n = len(places)
        return pa.record_batch([pa.array([name] * n, pa.string()), pa.array([chunk] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=COLUMNS)

    for place, line in lines:
        places.append(place)
        texts.append(line.removesuffix(b"\r").decode(errors="replace"))
        if len(places) == rows:
            yield batch()
            places, texts = [], []
    if places:
        yield batch()


@dataclass
class Range(InputPartition):
    name: str
    first: int
    start: int
    end: int


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        system, _ = located(self.path)
        for name, size in listed(self.path, self.pattern):
            try:
                with system.open_input_file(name) as handle:
                    to = finished(handle, size)
                    handle.seek(0)
                    out[name] = {"to": to, "head": handle.read(min(HEAD_BYTES, to)).hex()}
            except FileNotFoundError:  # gone since it was listed
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(*r) for r in ranges(start, end, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        with system.open_input_file(partition.name) as handle:
            yield from batches(partition.name, partition.start, lines_between(handle, partition.first, partition.start, partition.end))


@dataclass
class Quota(InputPartition):
    name: str
    lines: int


class PrefixReader(DataSourceReader):
    """The first lines of files: option ``quotas`` is a JSON list of (file, lines)."""

    def __init__(self, options: dict):
        self.path, self.quotas = options["path"], json.loads(options["quotas"])

    def partitions(self) -> list[Quota]:
        return [Quota(name, lines) for name, lines in self.quotas]

    def read(self, partition: Quota) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)

        def lines() -> Iterator[tuple[int, bytes]]:
            at, n, rest = 0, 0, b""
            with system.open_input_stream(partition.name, compression="detect", buffer_size=1 << 16) as stream:
                while n < partition.lines:
                    block = stream.read(1 << 16)
                    *whole, rest = (rest + block).split(b"\n")
                    if not block and rest:
                        whole = [rest]
                    for line in whole[:partition.lines - n]:
                        yield at, line
                        at, n = at + len(line) + 1, n + 1
                    if not block:
                        return

        yield from batches(partition.name, 0, lines())


class GrowingLines(DataSource):
    """``growing_lines``: options ``path``, ``pattern``, ``rangeBytes`` as a stream, ``path`` and ``quotas`` as a batch."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)

    def reader(self, schema) -> PrefixReader:
        return PrefixReader(self.options)


def follow_growing(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the lines that are added to the files of a folder, or to one file."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("pattern", pattern).option("rangeBytes", range_bytes).load(path)


def read_quotas(spark: SparkSession, path: str, quotas: list[tuple[str, int]]) -> DataFrame:
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").option("quotas", json.dumps(quotas)).load(path)


def prefix_lines(spark: SparkSession, path: str, n: int, pattern: str = "*") -> DataFrame:
    """The first ``n`` lines of a log whose files follow each other by name, of one file too.

    Files are opened in steps of twice as many until there are enough lines; no file is read beyond the lines that are still
    wanted of it, and later files are not opened at all.
    """
    names = [name for name, _ in listed(path, pattern)]
    quotas: list[tuple[str, int]] = []
    left, at, step = n, 0, 1
    while left > 0 and at < len(names):
        some = names[at:at + step]
        counts = {r["file"]: r["count"] for r in read_quotas(spark, path, [(name, left) for name in some]).groupBy("file").count().collect()}
        for name in some:
            if left > 0:
                quotas.append((name, min(left, counts.get(name, 0))))
                left -= quotas[-1][1]
        at, step = at + step, 2 * step
    return read_quotas(spark, path, quotas) if quotas else spark.createDataFrame([], SCHEMA)
