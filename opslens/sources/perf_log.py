"""Logs of the micro-benchmark runner as samples: benchmark, threads, ops/s.

The log is a list of benchmark names, each followed by its result lines, between headers
and noise.  A name is only known from the lines before it, so the parser needs line order;
it is a small state machine that walks all chunks at once.

How a line acts on the current name:
  narrow name   always becomes the current name
  wide name     (has ``_`` or ``-``) becomes it when there is none, otherwise clears it
  result        is a sample of the current name and leaves it
  other         clears it
The line after a version line is a commit hash and acts on nothing; so are header lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.automaton import CHUNK, Machine, run

# Fixed values of the log format.
CLIENT_LINE = "^MongoDB shell version: "
VERSION_LINE = "^db version: "
STRICT_VERSION_LINE = "^db version: [0-9.pre-]+$"
WIDE_NAME = "^[a-zA-Z.0-9_-]+$"
NARROW_NAME = "^[a-zA-Z.0-9]+$"
RESULT_LINE = r"^[0-9]+\s+[0-9.]+\s*"
RESULT_FIELDS = r"^([0-9]+)\s+(\S+)"

CLIENT, VERSION, RESULT, NARROW, WIDE, OTHER, HASH = "client", "version", "result", "narrow", "wide", "other", "hash"


def _line_kind(version_line: str, client_lines: bool) -> Column:
    """What a line looks like, before version lines swallow the line behind them."""
    line = F.col("value")
    kind = F.when(line.rlike(version_line), VERSION)
    if client_lines:
        kind = F.when(line.rlike(CLIENT_LINE), CLIENT).when(line.rlike(version_line), VERSION)
    return (kind.when(line.rlike(RESULT_LINE), RESULT).when(line.rlike(NARROW_NAME), NARROW)
            .when(line.rlike(WIDE_NAME), WIDE).otherwise(OTHER))


class Samples(Machine):
    """State: 1 after a version line, whose next line is a hash; 2 with a current name.

    Emits results with a name, and what the head of a log is made of: client lines, version lines and hashes.
    """
    states = 4
    texts = ("name",)
    reads = ("kind", "word")

    def step(self, state: int, memory: list, kind: str, word: str | None) -> tuple[int, bool]:
        if state & 1:
            return state - 1, True
        if kind == RESULT:
            return state, state == 2
        if kind == VERSION:
            return state + 1, True
        if kind == CLIENT:
            return state, True
        if kind == NARROW or kind == WIDE and state == 0:
            memory[0] = word
            return 2, False
        return 0, False


def perf_lines(lines: DataFrame, version_line: str = VERSION_LINE, client_lines: bool = True, strict: bool = False) -> DataFrame:
    """Samples and head lines in one walk; ``kind`` tells them apart.  ``samples_of`` and ``info_of`` read them.

    ``strict`` fails on a result that is no number; otherwise it is NULL.
    """
    field = lambda i: F.when(F.col("kind") == RESULT, F.regexp_extract("value", RESULT_FIELDS, i))
    number = field(2).cast("double") if strict else field(2).try_cast("double")
    looks = lines.withColumn("kind", _line_kind(version_line, client_lines)).select(
        *CHUNK, "pos", "kind", F.when(F.col("kind").isin(NARROW, WIDE), F.col("value")).alias("word"), "value",
        field(1).try_cast("int").alias("thread"), number.alias("result"))
    walked = run(looks, Samples(), ["kind", "thread", "result", "value"])
    return walked.withColumn("kind", F.when((F.col("state") % 2) == 1, HASH).otherwise(F.col("kind")))


def samples_of(walked: DataFrame) -> DataFrame:
    return walked.where(F.col("kind") == RESULT).select(*CHUNK, "pos", "name", "thread", "result")


def perf_samples(lines: DataFrame, version_line: str = VERSION_LINE, client_lines: bool = True,
                 strict: bool = False) -> DataFrame:
    """``file, chunk, pos, name, thread, result``, one row per result line that has a name."""
    return samples_of(perf_lines(lines, version_line, client_lines, strict))


def perf_log_info(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Per file: client version, server version, last hash, and whether versions conflict.

    ``strict`` fails when a file names two versions.
    """
    return info_of(perf_lines(lines), strict)


def info_of(walked: DataFrame, strict: bool = False) -> DataFrame:
    """The same from lines that were walked."""
    head = walked.where(F.col("kind").isin(CLIENT, VERSION, HASH))
    at = lambda k, by: F.when(F.col("kind") == k, F.col(by))
    per_chunk = head.groupBy("file", "chunk").agg(
        F.min_by("value", at(VERSION, "pos")).alias("version"),
        F.min_by("value", at(CLIENT, "pos")).alias("client_version"),
        F.max_by("value", at(HASH, "pos")).alias("git_sha"),
        *[end(at(k, "value")).alias(f"{name}_{k}")
          for k in (VERSION, CLIENT) for name, end in (("low", F.min), ("high", F.max))],
    )
    seen_in = lambda name: F.when(F.col(name).isNotNull(), F.col("chunk"))
    differs = lambda k: F.coalesce(F.min(f"low_{k}") != F.max(f"high_{k}"), F.lit(False))
    info = per_chunk.groupBy("file").agg(
        F.min_by("version", seen_in("version")).alias("version"),
        F.min_by("client_version", seen_in("client_version")).alias("client_version"),
        F.max_by("git_sha", seen_in("git_sha")).alias("git_sha"),
        (differs(VERSION) | differs(CLIENT)).alias("conflict"),
    )
    if strict:
        failed = F.raise_error(F.concat(F.lit("versions differ in "), "file")).cast("boolean")
        info = info.withColumn("conflict", F.when(F.col("conflict"), failed).otherwise(F.col("conflict")))
    return info.select("file", "client_version", "version", version_number(F.col("version")).alias("server_version"),
                       "git_sha", "conflict")


def version_number(version_line: Column) -> Column:
    """Third word of the version line."""
    return F.get(F.split(F.trim(version_line), r"\s+"), F.lit(2))


def sample_key(name: Column, thread: Column) -> Column:
    """Key of one benchmark at one thread count, as in ``Insert.Empty_TH-005``."""
    return F.concat(name, F.lit("_TH-"), F.format_string("%03d", thread))
