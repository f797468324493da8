"""HTTP access log lines as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.text import blanks, without
from opslens.sources.lines import log_lines

# Fixed values of the log format.
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss"
AGENT_URL = "^/ping/v[12]/(.+)$"
AGENT_REQUEST = "^POST /ping/v1/.*$"


def agent_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, AGENT_URL, 1), F.lit(""))


def is_agent_request(http: Column) -> Column:
    return http.rlike(AGENT_REQUEST)


def parse_access(lines: DataFrame) -> DataFrame:
    token = lambda i: F.get(F.col("t"), F.lit(i))
    cut = lines.select("file", "chunk", "pos", F.split(blanks(F.col("value")), " ", 13).alias("t"))
    read = cut.select(
        "file", "chunk", "pos",
        without(token(0), '"').alias("ip"),
        without(token(3), "[").alias("ts"),
        without(token(4), "]").alias("zone"),
        without(token(5), '"').alias("op"),
        token(6).alias("url"),
        without(token(11), '"').alias("http_agent"),
    )
    with_zone = F.try_to_timestamp(F.concat("ts", F.lit(" "), "zone"), F.lit(TIME_FORMAT + " Z"))
    bare = F.try_to_timestamp(F.col("ts"), F.lit(TIME_FORMAT))
    return read.select(
        "file", "chunk", "pos", "ip", "ts",
        F.unix_timestamp(F.coalesce(with_zone, bare)).alias("epoch"),
        "op", "url", "http_agent",
        F.concat("op", F.lit(" "), F.coalesce("url", F.lit(""))).alias("http"),
        agent_id(F.col("url")).alias("agent_id"),
    )


def read_access(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_access(log_lines(spark, paths))
