"""Client profiles over HTTP access events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.workload import counts
from opslens.sources.access import is_agent_request


def of_client(ip: str, method: str | None = None) -> Column:
    chosen = F.col("ip") == ip
    return chosen if method is None else chosen & (F.col("op") == method)


def method_counts(events: DataFrame) -> DataFrame:
    return counts(events, "op")


def client_methods(events: DataFrame, methods: list[str]) -> DataFrame:
    """One row per client, one column per method, in one pass."""
    return events.groupBy("ip").agg(*[F.count_if(F.col("op") == m).alias(m.lower()) for m in methods])


def client_method_counts(events: DataFrame) -> DataFrame:
    """The same for any set of methods: one row per client and method."""
    return counts(events, "ip", "op")


def distinct_clients(events: DataFrame) -> DataFrame:
    return events.select("ip").distinct()


def agent_clients(events: DataFrame) -> DataFrame:
    return events.where(is_agent_request(F.col("http"))).select("ip").distinct()


def requests_per_second(events: DataFrame, where: Column | None = None, first: int | None = None) -> DataFrame:
    """Requests per second, in order of time when the first seconds are wanted."""
    kept = events if where is None else events.where(where)
    table = counts(kept, "epoch", "ts")
    return table if first is None else table.orderBy("epoch", "ts").limit(first)


def repeated_requests(events: DataFrame, more_than: int = 1) -> DataFrame:
    return counts(events, "http").where(F.col("n") > more_than)


def agents(events: DataFrame) -> DataFrame:
    return events.where("agent_id IS NOT NULL").select("agent_id").distinct()


def unique_agents(events: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return events.agg(count("agent_id").alias("n_agents"))
