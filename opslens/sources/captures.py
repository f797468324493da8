"""Benchmark-tool captures: parameters, interval series and end results per file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.text import number
from opslens.operators.automaton import Machine, finals

# Fixed values of the capture formats: the name a tool prints for a setting -> our parameter.
# ``#`` stands for the number in settings that are printed as a phrase.
OLTP = ["range size", "point selects", "simple ranges", "sum ranges", "order ranges", "distinct ranges", "index updates", "non index updates"]
SYSBENCH_SETTINGS = {
    "writer threads": "nThreads", "collections": "nCollections", "documents per collection": "nCollectionSize",
    "feedback seconds": "nFeedbackSeconds", "run seconds": "nRunSeconds", **{f"oltp {x}": f"oltp {x}" for x in OLTP},
    "write concern": "write concern",
}
SYSBENCH_INSERT_SETTINGS = {
    "# writer thread(s)": "nThreads", "# collections": "nCollections", "# documents per collection": "nCollectionSize",
    "Feedback every # seconds(s)": "nFeedbackSeconds", "write concern": "write concern",
}
HAMMER_SETTINGS = {
    "conn": "nThreads", "avg(ms)": "avgResponseTime", "err ratio(%)": "errorRatio", "slow ratio(%)": "slowRatio", "ack/s": "ack/s",
}
SYSBENCH_INTERVAL = (
    "seconds : cum tps=([0-9.,]+) : int tps=([0-9.,]+) : cum ips=[0-9.,]+ : int ips=[0-9.,]+")
SYSBENCH_INSERT_INTERVAL = "seconds : cum ips=([0-9.,]+) : int ips=([0-9.,]+)"
HAMMER_INTERVAL = r"Last avg\(ms\):  ([0-9.]+)  send:  ([0-9]+)  "
# One setting of any tool, behind at most a thread name and two blanks: "name = value", "name : value", or a phrase.
NAMED_SETTING = r"(?:^|  )\s*(\S(?: ?\S)*?)\s+[=:] (\S+)"
PHRASED_SETTING = r"(?:^|  )\s*((?:\S+ )*?)([0-9][0-9,]*)( \S.*)$"
YCSB_RESULT, YCSB_COMMAND = "[OVERALL], Throughput(ops/sec)", "Command line:"
SIM_MARK = "==== perf metrics ===="
SIM_NODES = "STRUCT<summary: STRUCT<nodes: ARRAY<MAP<STRING, MAP<STRING, STRING>>>>>"
SIM_HEAD = """STRUCT<harness: STRING, workload: STRING, server_version: STRING, run_seconds: BIGINT, run_nanos: BIGINT,
    test_driver: STRUCT<version: STRING, git_hash: STRING, build_date: STRING>, attributes: STRING>"""


@dataclass(frozen=True)
class Harness:
    """How the captures of one tool are read.

    ``interval_word`` is a plain substring that every interval line holds; it is tested before
    any pattern.  ``whole`` names the parameters of which only the whole number counts.
    """

    report_name: str
    settings: dict[str, str] = field(default_factory=dict)
    interval: str = ""
    interval_word: str = ""
    interval_names: tuple[str, str] = ("cum", "interval")
    result_parameter: str | None = None
    whole: tuple[str, ...] = ()

    @property
    def parameters(self) -> list[str]:
        return list(self.settings.values())


HARNESSES = {
    "sysbench": Harness("sysbench", SYSBENCH_SETTINGS, SYSBENCH_INTERVAL, "seconds : cum tps="),
    "sysbench-insert": Harness("sysbench", SYSBENCH_INSERT_SETTINGS, SYSBENCH_INSERT_INTERVAL, "seconds : cum ips="),
    "hammer": Harness("hammer", HAMMER_SETTINGS, HAMMER_INTERVAL, "Last avg(ms):", ("avg", "send"), "ack/s", ("ack/s",)),
}


def _setting(value: Column) -> tuple[Column, Column]:
    """Name and value of a setting line; an empty name on other lines."""
    part = lambda pattern, i: F.regexp_extract(value, pattern, i)
    name = part(NAMED_SETTING, 1)
    phrase = F.when(part(PHRASED_SETTING, 2) != "", F.concat(part(PHRASED_SETTING, 1), F.lit("#"), part(PHRASED_SETTING, 3))).otherwise("")
    return F.when(name != "", name).otherwise(phrase), F.when(name != "", part(NAMED_SETTING, 2)).otherwise(part(PHRASED_SETTING, 2))


def _read(lines: DataFrame, harness: str) -> DataFrame:
    """Per file, in one pass over its lines: ``n_intervals, last`` and for parameter i ``matches_i, value_i``.

    The value of a parameter that several lines set is not known.
    """
    spec = HARNESSES[harness]
    is_interval = F.col("value").contains(spec.interval_word)
    first = number(F.regexp_extract("value", spec.interval, 1))
    name, text = _setting(F.col("value"))
    cut = lines.select("file", "chunk", "pos", F.when(is_interval, first).alias("first"),
                       F.when(~is_interval, F.struct(name.alias("name"), text.alias("text"))).alias("s"))
    known = F.when(F.col("s.name").isin(*spec.settings), F.col("s.name"))
    cut = cut.select("file", "chunk", "pos", "first", known.alias("name"), F.col("s.text").alias("text"))
    numbered = list(enumerate(spec.settings))
    # The collected set makes Spark aggregate text values by hash as well, without a sort.
    per_chunk = cut.groupBy("file", "chunk").agg(
        F.count("first").alias("n"), F.max_by("first", F.when(F.col("first").isNotNull(), F.col("pos"))).alias("last"),
        F.collect_set(F.lit(1)).alias("by_hash"),
        *[c for i, s in numbered for c in (F.count_if(F.col("name") == s).alias(f"matches_{i}"), F.max(F.when(F.col("name") == s, F.col("text"))).alias(f"value_{i}"))])
    per_file = per_chunk.groupBy("file").agg(
        F.sum("n").alias("n_intervals"), F.max_by("last", F.when(F.col("n") > 0, F.col("chunk"))).alias("last"), F.flatten(F.collect_set("by_hash")).alias("by_hash"),
        *[c for i, _ in numbered for c in (F.sum(f"matches_{i}").alias(f"matches_{i}"), F.max(f"value_{i}").alias(f"value_{i}"))])
    value = lambda i, s: F.regexp_extract(f"value_{i}", "^[0-9]+", 0) if spec.settings[s] in spec.whole else F.col(f"value_{i}")
    return per_file.select("file", "n_intervals", "last", *[f"matches_{i}" for i, _ in numbered],
                           *[F.when(F.col(f"matches_{i}") == 1, value(i, s)).alias(f"value_{i}") for i, s in numbered])


def _status(matches: Column) -> Column:
    return F.when(matches == 0, "missing").when(matches > 1, "ambiguous").otherwise("ok")


def parameters(lines: DataFrame, harness: str, strict: bool = False) -> DataFrame:
    """``file, param, value, matches, status`` for every file and every known parameter.

    Status is ``ok``, ``missing`` or ``ambiguous`` (found on several lines), the last two
    without a value; ``strict`` fails unless all are ``ok``.
    """
    rows = F.array(*[F.struct(F.lit(name).alias("param"), F.col(f"value_{i}").alias("value"), F.col(f"matches_{i}").alias("matches"))
                     for i, name in enumerate(HARNESSES[harness].parameters)])
    out = _read(lines, harness).select("file", F.inline(rows)).withColumn("status", _status(F.col("matches")))
    if strict:
        out = out.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(
            F.raise_error(F.concat_ws(" ", "file", "param", "status"))))
    return out


def intervals(lines: DataFrame, harness: str) -> DataFrame:
    """``file, chunk, pos`` and the two numbers of every interval line."""
    spec = HARNESSES[harness]
    first, second = spec.interval_names
    return (lines.where(F.col("value").contains(spec.interval_word))
            .select("file", "chunk", "pos",
                    number(F.regexp_extract("value", spec.interval, 1)).alias(first),
                    number(F.regexp_extract("value", spec.interval, 2)).alias(second))
            .where(F.col(first).isNotNull()))


def summary(lines: DataFrame, harness: str, strict: bool = False) -> DataFrame:
    """One row per file: throughput, number of intervals, the parameters as text, and ``status``.

    ``status`` is ``ok`` or lists the parameters that are missing or ambiguous; ``strict`` fails on those.
    """
    spec = HARNESSES[harness]
    faults = F.array(*[F.when(F.col(f"matches_{i}") != 1, F.concat(F.lit(f"{name} "), _status(F.col(f"matches_{i}"))))
                       for i, name in enumerate(spec.parameters)])
    status = F.array_join(F.array_compact(faults), ", ")
    out = _read(lines, harness).withColumn("status", F.when(status == "", "ok").otherwise(status))
    if strict:
        out = out.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat_ws(" ", "file", "status"))))
    named = {name: F.col(f"value_{i}") for i, name in enumerate(spec.parameters)}
    throughput = number(named[spec.result_parameter]) if spec.result_parameter else F.col("last")
    return out.select("file", throughput.alias("throughput"), "n_intervals",
                      *[c.alias(name) for name, c in named.items() if name != spec.result_parameter], "status")


class YcsbRun(Machine):
    """State 1 behind the first result, where nothing is remembered any more."""
    states = 2
    texts = ("command", "result")
    reads = ("value",)

    def step(self, state: int, memory: list, value: str) -> tuple[int, bool]:
        if state == 0:
            if YCSB_COMMAND in value:
                memory[0] = value
            elif YCSB_RESULT in value:
                memory[1] = value
                return 1, False
        return state, False


def ycsb_summary(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Per file: the first overall throughput and the last command line before it.

    A file without a result has no throughput and its last command line; ``strict`` fails on it.
    """
    wanted = F.col("value").contains(YCSB_COMMAND) | F.col("value").contains(YCSB_RESULT)
    # Files without either line are runs as well.
    found = lines.select("file").distinct().join(finals(lines.where(wanted), YcsbRun()), "file", "left")
    throughput = F.trim(F.get(F.split("result", ","), F.lit(2)))
    number_of = throughput.cast("double") if strict else throughput.try_cast("double")
    if strict:
        number_of = F.when(F.col("result").isNull(), F.raise_error(F.concat_ws(" ", "file", F.lit("has no result"))).cast("double")).otherwise(number_of)
    return found.select("file", number_of.alias("throughput"), F.col("command").alias("command_line"))


class SimReport(Machine):
    """State 1 on the line behind a marker."""
    states = 2
    texts = ("report",)
    reads = ("value",)

    def step(self, state: int, memory: list, value: str) -> tuple[int, bool]:
        if SIM_MARK in value:
            memory[0] = None
            return 1, False
        if state:
            memory[0] = value
        return 0, False


def sim_reports(lines: DataFrame) -> DataFrame:
    """``file, report``: the JSON text on the line after the last marker of each file; NULL where there is none."""
    return finals(lines, SimReport()).select("file", "report")


def sim_node_stats(lines: DataFrame) -> DataFrame:
    """``file, node_no, node, metric, value``: all statistics of all nodes."""
    nodes = sim_reports(lines).select("file", F.from_json("report", SIM_NODES).alias("r"))
    return (nodes.select("file", F.posexplode("r.summary.nodes").alias("node_no", "by_name"))
            .select("file", "node_no", F.explode("by_name").alias("node", "stats"))
            .select("file", "node_no", "node", F.explode("stats").alias("metric", "value"))
            .select("file", "node_no", "node", "metric", F.col("value").try_cast("double").alias("value")))


def sim_run(lines: DataFrame) -> DataFrame:
    """Run-level fields; attributes may be one object or a list of one-key objects."""
    read = sim_reports(lines).select("file", F.from_json("report", SIM_HEAD).alias("r"))
    as_map = F.from_json("r.attributes", "MAP<STRING, STRING>")
    as_list = F.from_json("r.attributes", "ARRAY<MAP<STRING, STRING>>")
    entries = F.flatten(F.transform(as_list, lambda m: F.map_entries(m)))
    is_list = F.substring("r.attributes", 1, 1) == "["
    return read.select("file", "r.harness", "r.workload", "r.server_version", "r.run_seconds", "r.run_nanos",
                       "r.test_driver", F.when(is_list, F.map_from_entries(entries)).otherwise(as_map).alias("attributes"))
