"""Shell output that is almost JSON: host, build, storage-engine and counter snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the shell format.
BANNER_LINES = 3
DATE_LINE = r"(?m)^[^\n]*: ISODate[^\n]*(?:\n|\z)"
LONG_LINE = r"(?m)^([^\n]*: )NumberLong\(([^()\n]*)\)"
LEGACY_ENGINE = "mmapv0"
COUNTERS = ["insert", "query", "update", "delete", "getmore", "command"]

HOST = """system STRUCT<hostname: STRING, cpuAddrSize: BIGINT, memSizeMB: BIGINT, numCores: BIGINT,
    cpuArch: STRING, numaEnabled: BOOLEAN>, os STRUCT<type: STRING, name: STRING, version: STRING>,
    extra STRUCT<versionString: STRING, libcVersion: STRING, kernelVersion: STRING, cpuFrequencyMHz: STRING,
    cpuFeatures: STRING, pageSize: BIGINT, numPages: BIGINT, maxOpenFiles: BIGINT>"""
BUILD = """version STRING, gitVersion STRING, OpenSSLVersion STRING, sysInfo STRING, loaderFlags STRING,
    compilerFlags STRING, allocator STRING, javascriptEngine STRING, bits INT, debug BOOLEAN"""


def cleaned(text: Column) -> Column:
    """Lines with dates dropped, long numbers unwrapped, banner removed; ``undefined`` is NULL."""
    no_dates = F.when(text.contains("ISODate"), F.regexp_replace(text, DATE_LINE, "")).otherwise(text)
    plain = F.when(text.contains("NumberLong"), F.regexp_replace(no_dates, LONG_LINE, "$1$2")).otherwise(no_dates)
    payload = F.regexp_replace(plain, rf"\A(?:[^\n]*\n){{{BANNER_LINES}}}(?:\s*undefined\b[\s\S]*)?", "")
    return F.nullif(F.trim(payload), F.lit(""))


def parse_server_info(snapshots: DataFrame) -> DataFrame:
    """``server`` and the three texts ``host_text, build_text, engine_text`` as structs.

    A server without storage-engine output is a legacy one.
    """
    read = snapshots.withColumns({name: cleaned(F.col(name)) for name in ("host_text", "build_text", "engine_text")})
    engine = F.coalesce(F.get_json_object("engine_text", "$.name"), F.when(F.col("engine_text").isNull(), LEGACY_ENGINE))
    return read.select("server", F.from_json("host_text", HOST).alias("host"),
                       F.from_json("build_text", BUILD).alias("build"), engine.alias("storage_engine"))


def with_operations(snapshots: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sum of the operation counters, given bare or wrapped in ``opcounters``."""
    read = snapshots.withColumn("payload", cleaned(F.col(text)))
    wrapped = F.from_json("payload", "opcounters MAP<STRING, BIGINT>").getField("opcounters")
    read = read.withColumn("payload", F.coalesce(wrapped, F.from_json("payload", "MAP<STRING, BIGINT>")))
    known = F.map_filter("payload", lambda key, n: key.isin(*COUNTERS))
    total = F.aggregate(F.map_values(known), F.lit(0).cast("bigint"), lambda sum_, n: sum_ + F.coalesce(n, F.lit(0)))
    return read.withColumn(name, F.coalesce(total, F.lit(0).cast("bigint"))).drop("payload")
