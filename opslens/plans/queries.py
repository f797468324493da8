"""Queries over the benchmark tables, each beside the SQL that checks it.

A query renders a table as log text, parses it and applies one operator.  Its SQL answers
from the table columns alone.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators import changes, counters, http, keyed_sum, perf, runs, synth, user_reduce, workload
from opslens.plans import render
from opslens.session import scratch_dir
from opslens.sinks import report, rollups, tables
from opslens.sinks import events as event_store
from opslens.sources import access, captures, csv_tail, dblog, oplog, perf_log, pidstat, shell_json
from opslens.sources.growing import follow_growing, prefix_lines
from opslens.sources.lines import first_lines, log_lines
from opslens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return register


# ---------------------------------------------------------------- database log

EV = """
WITH ev AS (
  SELECT event_id, user_id, event_type, value, ts,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second,
    json_extract_string(props, '$.k') AS k,
    CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'skipped' ELSE 'ok' END AS parse_status,
    CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'command' WHEN 'purchase' THEN 'update'
      WHEN 'signup' THEN 'insert' ELSE CASE WHEN event_id % 2 = 0 THEN 'getmore' END END AS op,
    CASE event_type WHEN 'click' THEN '$cmd' WHEN 'purchase' THEN 'orders' WHEN 'signup' THEN 'users' ELSE 'views' END AS coll,
    CASE WHEN event_type = 'click' THEN
      CASE event_id % 3 WHEN 0 THEN 'isMaster' WHEN 1 THEN 'getLastError' ELSE 'count' END END AS cmd,
    CASE WHEN event_type = 'view' THEN CASE event_id % 2 WHEN 1 THEN 'COLLSCAN' ELSE 'IXSCAN' END END AS q_plan,
    CASE WHEN event_type = 'purchase' THEN
      CASE event_id % 4 WHEN 0 THEN '$inc' WHEN 1 THEN '$set' WHEN 2 THEN '$pull' ELSE 'update' END END AS change
  FROM events),
log AS (
  SELECT *,
    CASE WHEN op IS NOT NULL THEN second END AS epoch,
    CASE WHEN op IS NOT NULL THEN 'shop' || (user_id % 4) || '.' || coll END AS ns,
    CASE WHEN op IS NOT NULL THEN 'shop' || (user_id % 4) END AS db,
    CASE op WHEN 'command' THEN cmd
      WHEN 'update' THEN 'update' || CASE change WHEN 'update' THEN 'update' ELSE '-' || change END ELSE op END AS op_read,
    CASE op
      WHEN 'query' THEN ':$orderby<:fieldname>:$query<:fieldname<:$lte>:fieldname>&' || q_plan
      WHEN 'update' THEN ':_id' END AS q_norm,
    CASE WHEN op = 'update' THEN CASE change WHEN 'update' THEN ':fieldname' ELSE ':' || change || '<:fieldname>' END END
      AS update_norm,
    CASE op
      WHEN 'query' THEN '{ "OP_query": { "uid": "' || user_id || '", "k": { "OP_lte": "' || k || '" } }, "OP_orderby": { "ts": "-1" } }'
      WHEN 'update' THEN '{ "ID": "' || event_id || '" }' END AS q_json,
    CASE WHEN op = 'update' THEN CASE change WHEN 'update' THEN '{ "n": "1" }'
      ELSE '{ "OP_' || substr(change, 2) || '": { "n": "1" } }' END END AS update_json
  FROM ev)
"""


def db_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dblog.parse_dblog(render.dblog(spark, sf_dir))


@query("mongod_events", EV + """
SELECT event_id, CASE WHEN op IS NOT NULL THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+0000' END AS ts, epoch,
  CASE WHEN op IS NOT NULL THEN '[conn' || user_id || ']' END AS conn, op, ns, cmd,
  replace(q_json, '"', '') AS q_string, q_norm, q_plan, update_norm, parse_status
FROM log""")
def mongod_events(spark, sf_dir):
    events = dblog.with_shapes(dblog.with_predicates(db_events(spark, sf_dir)))
    return events.select(F.col("pos").alias("event_id"), "ts", "epoch", "conn", "op", "ns", "cmd", "q_string", "q_norm",
                         "q_plan", "update_norm", "parse_status")


@query("query_predicates", EV + """
SELECT event_id, q_json, replace(q_json, '"', '') AS q_string, update_json FROM log WHERE op IN ('query', 'update')""")
def query_predicates(spark, sf_dir):
    events = dblog.with_predicates(db_events(spark, sf_dir)).where(F.col("op").isin("query", "update"))
    return events.select(F.col("pos").alias("event_id"), "q_json", "q_string", "update_json")


@query("query_shape_of", EV + "SELECT event_id, q_norm, update_norm FROM log WHERE op IN ('query', 'update')")
def query_shape_of(spark, sf_dir):
    events = dblog.with_shapes(db_events(spark, sf_dir).where(F.col("op").isin("query", "update")))
    return events.select(F.col("pos").alias("event_id"), "q_norm", "update_norm")


@query("loaded_rows", EV + "SELECT 'db.log' AS file, parse_status, count(*) AS n FROM log GROUP BY ALL")
def loaded_rows(spark, sf_dir):
    return workload.loaded_rows(db_events(spark, sf_dir))


@query("ns_events", EV + "SELECT event_id, epoch, op, ns FROM log WHERE ns = 'shop1.views'")
def ns_events(spark, sf_dir):
    events = dblog.parse_dblog(render.dblog(spark, sf_dir), where=workload.in_namespace("shop1.views"))
    return events.select(F.col("pos").alias("event_id"), "epoch", "op", "ns")


ODD = f"""
WITH kinds(kind, op, shape, plan, parse_status) AS (VALUES
  (0, 'query', ':$and[:fieldname:fieldname<:$lte>]', 'COLLSCAN', 'ok'), (1, 'query', ':fieldname<:$in>', 'IXSCAN', 'ok'),
  (2, 'query', ':$or[:_id:fieldname]', 'IXSCAN', 'ok'), (3, 'query', '$COLLSCAN', NULL, 'ok'), (4, 'query', '$EOF', NULL, 'ok'),
  (5, 'query', ':fieldname:fieldname', 'EOF', 'ok'),
  (6, 'query', repeat(':fieldname<', {render.DEEP - 1}) || ':fieldname' || repeat('>', {render.DEEP - 1}), 'IXSCAN', 'ok'),
  (7, 'query', ':fieldname', 'IXSCAN', 'ok'), (8, 'query', ':fieldname:fieldname', 'EOF', 'ok'), (9, 'query', NULL, 'IXSCAN', 'unreadable'),
  (10, 'query', ':fieldname[##]:fieldname[:fieldname#]', 'COLLSCAN', 'ok'), (11, 'remove', NULL, NULL, 'ok'), (12, NULL, NULL, NULL, 'error'),
  (13, 'update', ':_id', NULL, 'ok'), (14, NULL, NULL, NULL, 'skipped'), (15, 'query', ':fieldname<>:fieldname[]', 'IXSCAN', 'ok')),
odd AS (
  SELECT event_id, op, parse_status, plan, CASE WHEN op IS NOT NULL THEN 'odd' || (user_id % 4) || '.docs' END AS ns,
    CASE WHEN op IS NOT NULL THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS epoch,
    shape || coalesce('&' || plan, '') AS q_norm, CASE op WHEN 'update' THEN 'update-$set' ELSE op END AS op_read
  FROM events JOIN kinds ON event_id % 16 = kind)
"""


def odd_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dblog.parse_dblog(render.odd_dblog(spark, sf_dir))


@query("odd_events", ODD + "SELECT event_id, epoch, op, ns, q_norm, plan AS q_plan, parse_status FROM odd")
def odd_log_events(spark, sf_dir):
    """Lines with deep, listed, missing and broken documents keep operation, namespace and time."""
    return dblog.with_shapes(odd_events(spark, sf_dir)).select(
        F.col("pos").alias("event_id"), "epoch", "op", "ns", "q_norm", "q_plan", "parse_status")


@query("odd_loaded_rows", ODD + "SELECT 'odd.log' AS file, parse_status, count(*) AS n FROM odd GROUP BY ALL")
def odd_loaded_rows(spark, sf_dir):
    return workload.loaded_rows(odd_events(spark, sf_dir))


@query("odd_ns_load", ODD + "SELECT ns, op_read, count(*) AS n FROM odd WHERE parse_status <> 'skipped' GROUP BY ALL")
def odd_ns_load(spark, sf_dir):
    return workload.ns_load(odd_events(spark, sf_dir))


@query("odd_query_shapes", ODD + """
SELECT q_norm AS shape, count(DISTINCT ns) AS n_ns, count(*) AS n, any_value(coalesce(plan, 'none')) AS plans
FROM odd WHERE op = 'query' AND q_norm IS NOT NULL GROUP BY q_norm""")
def odd_query_shapes(spark, sf_dir):
    return workload.query_shapes(odd_events(spark, sf_dir)).select("shape", "n_ns", "n", "plans")


@query("ops_per_second", EV + "SELECT epoch, count(*) AS n FROM log GROUP BY epoch")
def ops_per_second(spark, sf_dir):
    return workload.ops_per_second(db_events(spark, sf_dir))


@query("query_ops_per_second", EV + "SELECT epoch, count(*) AS n FROM log WHERE op = 'query' GROUP BY epoch")
def query_ops_per_second(spark, sf_dir):
    return workload.ops_per_second(db_events(spark, sf_dir), workload.is_op("query"))


RATES = """
, rates AS (SELECT epoch, count(*) AS all_ops, count(*) FILTER (op = 'update') AS update_ops,
  count(*) FILTER (op = 'command') AS command_ops, count(*) FILTER (op = 'query') AS query_ops,
  count(*) FILTER (op = 'insert') AS insert_ops, count(*) FILTER (op = 'getmore') AS getmore_ops FROM log GROUP BY epoch)
"""


@query("ops_per_second_by_op", EV + RATES + "SELECT * FROM rates ORDER BY epoch NULLS FIRST LIMIT 1000")
def ops_per_second_by_op(spark, sf_dir):
    return workload.ops_per_second_by_op(db_events(spark, sf_dir), first=1000)


@query("ops_per_second_series", EV + RATES + """
, series AS (
  SELECT epoch, 'all' AS series, all_ops AS n FROM rates UNION ALL SELECT epoch, 'update', update_ops FROM rates
  UNION ALL SELECT epoch, 'command', command_ops FROM rates UNION ALL SELECT epoch, 'query', query_ops FROM rates
  UNION ALL SELECT epoch, 'insert', insert_ops FROM rates UNION ALL SELECT epoch, 'getmore', getmore_ops FROM rates),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY epoch NULLS FIRST) AS rank FROM series WHERE n > 0)
SELECT epoch, series, n FROM ranked WHERE rank <= 1000""")
def ops_per_second_series(spark, sf_dir):
    return workload.ops_per_second_by_op(db_events(spark, sf_dir), first=1000, per_series=True)


@query("op_counts", EV + "SELECT op, count(*) AS n FROM log GROUP BY op")
def op_counts(spark, sf_dir):
    return workload.op_counts(db_events(spark, sf_dir))


@query("ns_counts", EV + "SELECT ns, count(*) AS n FROM log WHERE parse_status <> 'skipped' GROUP BY ns")
def ns_counts(spark, sf_dir):
    return workload.ns_counts(db_events(spark, sf_dir))


@query("db_counts", EV + "SELECT db, count(*) AS n FROM log WHERE parse_status <> 'skipped' GROUP BY db")
def db_counts(spark, sf_dir):
    return workload.db_counts(db_events(spark, sf_dir))


@query("cmd_counts", EV + "SELECT cmd, count(*) AS n FROM log WHERE parse_status <> 'skipped' GROUP BY cmd")
def cmd_counts(spark, sf_dir):
    return workload.cmd_counts(db_events(spark, sf_dir))


@query("plan_mix", EV + "SELECT q_plan, count(*) AS n FROM log WHERE op = 'query' GROUP BY q_plan")
def plan_mix(spark, sf_dir):
    return workload.plan_mix(db_events(spark, sf_dir))


@query("ns_load", EV + "SELECT ns, op_read, count(*) AS n FROM log WHERE parse_status <> 'skipped' GROUP BY ns, op_read")
def ns_load(spark, sf_dir):
    return workload.ns_load(db_events(spark, sf_dir))


FIRST_QUERY = """
SELECT q_norm AS shape, count(DISTINCT ns) AS n_ns, count(*) AS n, q_plan AS plans, arg_min(q_json, event_id) AS q,
  min(event_id) AS first_event FROM log WHERE op = 'query' {extra} GROUP BY q_norm, q_plan"""


def _with_first_event(shapes: DataFrame, pattern: str) -> DataFrame:
    """Replaces the sample line by the event number that the render put into it."""
    return shapes.withColumn("first_event", F.regexp_extract("raw", pattern, 1).try_cast("bigint")).drop("raw")


def _query_shapes(spark, sf_dir, ns=None):
    lines = render.dblog(spark, sf_dir)
    numbered = lines.withColumn("value", F.concat("value", F.lit(" #"), F.col("pos").cast("string")))
    return _with_first_event(workload.query_shapes(dblog.parse_dblog(numbered, where=None if ns is None else workload.in_namespace(ns)), ns), " #([0-9]+)$")


@query("query_shapes", EV + FIRST_QUERY.format(extra=""))
def query_shapes(spark, sf_dir):
    return _query_shapes(spark, sf_dir)


@query("query_shapes_ns", EV + FIRST_QUERY.format(extra="AND ns = 'shop1.views'"))
def query_shapes_ns(spark, sf_dir):
    return _query_shapes(spark, sf_dir, "shop1.views")


def stored_events(spark, lines, **filters):
    """The events of ``lines`` written to a store and read back with ``filters``."""
    path = scratch_dir(spark, "events")
    event_store.write_events(dblog.parse_dblog(lines), path)
    return event_store.read_events(spark, path, **filters)


@query("stored_ns_load", EV + """
SELECT ns, op_read, count(*) AS n FROM log WHERE parse_status <> 'skipped' AND op IN ('update', 'insert') GROUP BY ns, op_read""")
def stored_ns_load(spark, sf_dir):
    return workload.ns_load(stored_events(spark, render.dblog(spark, sf_dir), ops=["update", "insert"]))


@query("stored_query_shapes", EV + FIRST_QUERY.format(extra="AND ns = 'shop1.views'"))
def stored_query_shapes(spark, sf_dir):
    lines = render.dblog(spark, sf_dir)
    numbered = lines.withColumn("value", F.concat("value", F.lit(" #"), F.col("pos").cast("string")))
    return _with_first_event(workload.query_shapes(stored_events(spark, numbered, ns="shop1.views", ops=["query"])), " #([0-9]+)$")


def rolled_up(spark, sf_dir):
    """Three logs loaded under their names, one of them twice."""
    path = scratch_dir(spark, "rollups")
    logs = render.dblog(spark, sf_dir, file=render.text("log-", F.col("user_id") % 3))
    for load in ("log-0", "log-1", "log-2", "log-1"):
        rollups.load_events(dblog.parse_dblog(logs.where(F.col("file") == load)), path, load)
    return path


@query("rollup_ns_load", EV + "SELECT ns, op_read, count(*) AS n FROM log WHERE parse_status <> 'skipped' GROUP BY ns, op_read")
def rollup_ns_load(spark, sf_dir):
    """Namespace load from stored partial counts; no event is read."""
    return rollups.kind_counts(spark, rolled_up(spark, sf_dir), "ns", "op_read")


@query("rollup_db_days", EV + """
SELECT db, op, count(*) AS n FROM log WHERE parse_status <> 'skipped' AND CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY db, op""")
def rollup_db_days(spark, sf_dir):
    return rollups.kind_counts(spark, rolled_up(spark, sf_dir), rollups.database(), "op", first_day="2024-01-05", last_day="2024-01-20")


@query("rollup_ops_per_second", EV + "SELECT epoch, op, count(*) AS n FROM log WHERE parse_status <> 'skipped' GROUP BY epoch, op")
def rollup_ops_per_second(spark, sf_dir):
    return rollups.rates(spark, rolled_up(spark, sf_dir), by_op=True)


@query("loaded_ns_events", EV + "SELECT epoch, op, count(*) AS n FROM log WHERE ns = 'shop1.views' GROUP BY epoch, op")
def loaded_ns_events(spark, sf_dir):
    """Events of a store where one load came twice."""
    return workload.counts(rollups.loaded_events(spark, rolled_up(spark, sf_dir), "shop1.views"), "epoch", "op")


@query("update_shapes", EV + """
SELECT update_norm AS shape, count(DISTINCT ns) AS n_ns, count(*) AS n, 'none' AS plans,
  arg_min(update_json, event_id) AS q, min(event_id) AS first_event FROM log WHERE op = 'update' GROUP BY update_norm""")
def update_shapes(spark, sf_dir):
    return _with_first_event(workload.update_shapes(db_events(spark, sf_dir)), r"query: \{ _id: ([0-9]+) \}")


@query("canonical_records", EV + """
SELECT q_norm, replace(q_json, '"', '') AS q_string, count(*) AS n FROM log GROUP BY ALL""")
def canonical_records(spark, sf_dir):
    return workload.canonical_records(db_events(spark, sf_dir))


@query("canonical_summary", EV + """
SELECT q_norm, count(DISTINCT ns) + max(CASE WHEN ns IS NULL THEN 1 ELSE 0 END) AS n_ns, count(*) AS n
FROM log GROUP BY q_norm""")
def canonical_summary(spark, sf_dir):
    return workload.canonical_summary(db_events(spark, sf_dir))


FIELDS = """
, fields AS (SELECT q_norm, unnest(['uid', 'k']) AS field, unnest(['string', 'rand-int lte']) AS type FROM log WHERE op = 'query')
"""


@query("shape_schema", EV + FIELDS + "SELECT q_norm, field, type, count(*) AS n FROM fields GROUP BY ALL")
def shape_schema(spark, sf_dir):
    return workload.schema_fields(db_events(spark, sf_dir))


@query("shape_index_keys", EV + FIELDS + "SELECT DISTINCT q_norm, field, 1 AS direction FROM fields")
def shape_index_keys(spark, sf_dir):
    return workload.index_keys(workload.schema_fields(db_events(spark, sf_dir)))


@query("log_prefix_op_counts", EV + """
SELECT op, count(*) AS n FROM (SELECT op FROM log ORDER BY event_id LIMIT 10000) GROUP BY op""")
def log_prefix_op_counts(spark, sf_dir):
    # The first 10000 lines are what the report asks for.
    return workload.op_counts(dblog.parse_dblog(first_lines(render.dblog(spark, sf_dir), 10_000)))


@query("log_file_prefix_op_counts", EV + """
SELECT op, count(*) AS n FROM (SELECT op FROM log ORDER BY event_id LIMIT 10000) GROUP BY op""")
def log_file_prefix_op_counts(spark, sf_dir):
    """The same from a log of several files, of which only the first lines are read."""
    folder = scratch_dir(spark, "ordered-log")
    render.dblog(spark, sf_dir).orderBy("pos").select("value").write.text(folder)
    return workload.op_counts(dblog.parse_dblog(prefix_lines(spark, folder, 10_000, "part-*")))


@query("gzip_log_op_counts", EV + """
SELECT 'log-' || (user_id % 3) AS source, op, count(*) AS n FROM log GROUP BY ALL""")
def gzip_log_op_counts(spark, sf_dir):
    """Compressed logs, whose lines are dealt to many tasks after they were read."""
    folder = scratch_dir(spark, "gzip-logs")
    logs = render.dblog(spark, sf_dir, file=render.text("log-", F.col("user_id") % 3))
    logs.select("file", "value").write.partitionBy("file").option("compression", "gzip").text(folder)
    events = dblog.parse_dblog(log_lines(spark, folder, spread=True))
    return workload.counts(events.withColumn("source", F.regexp_extract("file", "file=([^/]+)/", 1)), "source", "op")


@query("multi_log_op_counts", EV + """
SELECT 'log-' || (user_id % 3) AS source, op, count(*) AS n FROM log GROUP BY ALL""")
def multi_log_op_counts(spark, sf_dir):
    logs = render.dblog(spark, sf_dir, file=render.text("log-", F.col("user_id") % 3))
    folder = scratch_dir(spark, "logs")
    logs.select("file", "value").write.partitionBy("file").text(folder)
    source = F.regexp_extract("file", "file=([^/]+)/", 1)
    events = dblog.parse_dblog(log_lines(spark, folder)).withColumn("source", source)
    return workload.counts(events, "source", "op")


# ---------------------------------------------------------------- access log

ACCESS = """
WITH log AS (
  SELECT event_id, '10.0.' || (user_id // 16) || '.' || (user_id % 16) AS ip,
    strftime(ts, '%d/%b/%Y:%H:%M:%S') AS ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'POST' ELSE 'GET' END AS op,
    CASE event_type WHEN 'click' THEN '/ping/v1/agent' || user_id WHEN 'purchase' THEN '/ping/v2/agent' || user_id
      ELSE '/' || event_type || '/' || json_extract_string(props, '$.k') END AS url,
    'Client/' || (user_id % 3) AS http_agent,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'agent' || user_id END AS agent_id
  FROM events)
"""
CLIENT = "10.0.1.3"


def access_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.parse_access(render.access(spark, sf_dir))


@query("access_events", ACCESS + """
SELECT event_id, ip, ts, epoch, op, url, http_agent, op || ' ' || url AS http, agent_id FROM log""")
def access_events(spark, sf_dir):
    return access_rows(spark, sf_dir).select(
        F.col("pos").alias("event_id"), "ip", "ts", "epoch", "op", "url", "http_agent", "http", "agent_id")


@query("http_method_counts", ACCESS + "SELECT op, count(*) AS n FROM log GROUP BY op")
def http_method_counts(spark, sf_dir):
    return http.method_counts(access_rows(spark, sf_dir))


@query("client_method_pivot", ACCESS + """
SELECT ip, count(*) FILTER (op = 'GET') AS "get", count(*) FILTER (op = 'POST') AS post FROM log GROUP BY ip""")
def client_method_pivot(spark, sf_dir):
    return http.client_methods(access_rows(spark, sf_dir), ["GET", "POST"])


@query("access_file_methods", ACCESS + "SELECT op, count(*) AS n FROM log GROUP BY op")
def access_file_methods(spark, sf_dir):
    """The same from files, through the reader."""
    folder = scratch_dir(spark, "access")
    render.access(spark, sf_dir).select("value").write.text(folder)
    return http.method_counts(access.read_access(spark, folder))


@query("client_method_counts", ACCESS + "SELECT ip, op, count(*) AS n FROM log GROUP BY ip, op")
def client_method_counts(spark, sf_dir):
    return http.client_method_counts(access_rows(spark, sf_dir))


@query("distinct_clients", ACCESS + "SELECT DISTINCT ip FROM log")
def distinct_clients(spark, sf_dir):
    return http.distinct_clients(access_rows(spark, sf_dir))


@query("agent_clients", ACCESS + "SELECT DISTINCT ip FROM log WHERE op = 'POST' AND url LIKE '/ping/v1/%'")
def agent_clients(spark, sf_dir):
    return http.agent_clients(access_rows(spark, sf_dir))


@query("rps", ACCESS + "SELECT epoch, ts, count(*) AS n FROM log GROUP BY epoch, ts")
def rps(spark, sf_dir):
    return http.requests_per_second(access_rows(spark, sf_dir))


@query("rps_client", ACCESS + f"""
SELECT epoch, ts, count(*) AS n FROM log WHERE ip = '{CLIENT}' GROUP BY epoch, ts ORDER BY epoch LIMIT 100""")
def rps_client(spark, sf_dir):
    return http.requests_per_second(access_rows(spark, sf_dir), http.of_client(CLIENT), first=100)


@query("rps_client_post", ACCESS + f"""
SELECT epoch, ts, count(*) AS n FROM log WHERE ip = '{CLIENT}' AND op = 'POST'
GROUP BY epoch, ts ORDER BY epoch LIMIT 100""")
def rps_client_post(spark, sf_dir):
    return http.requests_per_second(access_rows(spark, sf_dir), http.of_client(CLIENT, "POST"), first=100)


@query("repeated_requests", ACCESS + """
SELECT op || ' ' || url AS http, count(*) AS n FROM log GROUP BY 1 HAVING count(*) > 1""")
def repeated_requests(spark, sf_dir):
    return http.repeated_requests(access_rows(spark, sf_dir))


@query("unique_agents", ACCESS + "SELECT count(DISTINCT agent_id) AS n_agents FROM log")
def unique_agents(spark, sf_dir):
    return http.unique_agents(access_rows(spark, sf_dir))


@query("agents_by_sketch", ACCESS + """
SELECT CAST(make_timestamp(epoch * 1000000) AS DATE) AS day, count(DISTINCT agent_id) AS n_agents, TRUE AS within_error FROM log WHERE agent_id IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT agent_id), TRUE FROM log""")
def agents_by_sketch(spark, sf_dir):
    """Distinct agents by day and in all from stored sketches, beside the exact numbers: within three standard errors."""
    rows, path = access_rows(spark, sf_dir), scratch_dir(spark, "sketches")
    day = F.to_date(F.timestamp_seconds("epoch"))
    for load in range(3):  # three deliveries, one of which comes twice
        rollups.write_sketches(rows.where(F.col("pos") % 3 == load), day, F.col("agent_id"), path, str(load))
    rollups.write_sketches(rows.where(F.col("pos") % 3 == 1), day, F.col("agent_id"), path, "1")
    none = F.lit(None).cast("date").alias("day")
    estimates = rollups.distinct_estimate(spark, path, "day").unionByName(rollups.distinct_estimate(spark, path).select(none, "estimate"))
    known = rows.where("agent_id IS NOT NULL")
    exact = known.groupBy(day.alias("day")).agg(F.countDistinct("agent_id").alias("n_agents")).unionByName(
        known.agg(F.countDistinct("agent_id").alias("n_agents")).select(none, "n_agents"))
    both = exact.join(estimates.withColumnRenamed("day", "d"), F.col("day").eqNullSafe(F.col("d")), "left")
    error = F.abs(F.col("estimate") - F.col("n_agents")) / F.col("n_agents")
    return both.select("day", "n_agents", F.coalesce(error <= 3 * rollups.SKETCH_ERROR, F.lit(False)).alias("within_error"))


@query("agents", ACCESS + "SELECT DISTINCT agent_id FROM log WHERE agent_id IS NOT NULL")
def agents(spark, sf_dir):
    return http.agents(access_rows(spark, sf_dir))


# ---------------------------------------------------------------- operation log, profiler

OPLOG = """
WITH log AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'i' ELSE 'u' END AS op, 'shop.' || o_orderpriority AS ns,
    CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_custkey AS VARCHAR) AS i, o_orderstatus AS g FROM orders)
"""


def oplog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.parse_oplog(render.oplog(spark, sf_dir))


def _oplog_columns(rows: DataFrame) -> DataFrame:
    return rows.select("op", "ns", "doc_id", "i", "g")


@query("oplog_events", OPLOG + "SELECT op, ns, doc_id, i, g FROM log")
def oplog_events(spark, sf_dir):
    return _oplog_columns(oplog_rows(spark, sf_dir))


@query("oplog_inserts", OPLOG + "SELECT op, ns, doc_id, i, g FROM log WHERE op = 'i'")
def oplog_inserts(spark, sf_dir):
    return _oplog_columns(oplog_rows(spark, sf_dir).where(changes.is_insert()))


@query("oplog_updates", OPLOG + "SELECT op, ns, doc_id, i, g FROM log WHERE op = 'u'")
def oplog_updates(spark, sf_dir):
    return _oplog_columns(oplog_rows(spark, sf_dir).where(changes.is_update()))


@query("oplog_ns_counts", OPLOG + "SELECT ns, count(*) AS n FROM log GROUP BY ns")
def oplog_ns_counts(spark, sf_dir):
    return changes.ns_counts(oplog_rows(spark, sf_dir))


@query("oplog_distinct_groups", OPLOG + """
SELECT count(DISTINCT i || '-' || g) AS n_groups FROM log WHERE op = 'i' AND ns = 'shop.1-URGENT'""")
def oplog_distinct_groups(spark, sf_dir):
    return changes.distinct_groups(oplog_rows(spark, sf_dir), "shop.1-URGENT")


@query("profile_ops_per_second", EV + """
SELECT second AS epoch, count(*) AS all_ops, count(*) FILTER (event_type = 'purchase') AS update_ops,
  count(*) FILTER (event_type = 'view') AS query_ops FROM log GROUP BY second""")
def profile_ops_per_second(spark, sf_dir):
    return changes.profile_ops_per_second(oplog.profile_events(render.profile(spark, sf_dir)))


def profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiler records exported as JSON lines and read back."""
    folder = scratch_dir(spark, "profile")
    render.profile(spark, sf_dir).write.json(folder)
    return oplog.read_profile(spark, folder)


@query("profile_file_ops_per_second", EV + """
SELECT second AS epoch, count(*) AS all_ops, count(*) FILTER (event_type = 'purchase') AS update_ops,
  count(*) FILTER (event_type = 'view') AS query_ops FROM log GROUP BY second""")
def profile_file_ops_per_second(spark, sf_dir):
    return changes.profile_ops_per_second(profile_export(spark, sf_dir))


@query("profile_rows", "SELECT count(*) AS n FROM events")
def profile_rows(spark, sf_dir):
    return profile_export(spark, sf_dir).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- benchmark logs

PERF = """
WITH stats AS (
  SELECT 'perf-' || l_linestatus || '.log' AS file, 'Item.' || l_returnflag AS name, l_linenumber AS thread,
    count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd
  FROM lineitem WHERE l_linestatus <> 'F' OR l_linenumber <> 7 GROUP BY ALL),
cvs AS (
  SELECT file, name, thread, n, mean, 100 * sd / mean AS cv,
    CASE WHEN n = 1 THEN 'n/a' ELSE printf('%.2f%%', 100 * sd / mean) END AS cv_str FROM stats),
compared AS (
  SELECT w.name || '_TH-' || printf('%03d', w.thread) AS key, w.name, w.thread, o.mean AS old_mean, o.cv AS old_cv,
    o.cv_str AS old_cv_str, w.mean AS new_mean, w.cv AS new_cv, w.cv_str AS new_cv_str, w.mean / o.mean AS ratio,
    printf('%+.2f%%', 100 * (w.mean / o.mean) - 100) AS delta,
    coalesce(w.mean / o.mean - 1 < -0.05, false) AS regression,
    coalesce(floor(round(o.cv, 2) * 10 + 1e-6) / 10 > 3, false) AS old_noisy,
    coalesce(floor(round(w.cv, 2) * 10 + 1e-6) / 10 > 3, false) AS new_noisy
  FROM cvs w LEFT JOIN cvs o ON o.file = 'perf-F.log' AND o.name = w.name AND o.thread = w.thread
  WHERE w.file = 'perf-O.log')
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf_log.perf_samples(render.perf(spark, sf_dir))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.compare_files(samples(spark, sf_dir), render.OLD_PERF, render.NEW_PERF)


@query("perf_samples", """
SELECT 'perf-' || l_linestatus || '.log' AS file, 'Item.' || l_returnflag AS name, l_linenumber AS thread,
  l_extendedprice AS result FROM lineitem WHERE l_linestatus <> 'F' OR l_linenumber <> 7""")
def perf_samples(spark, sf_dir):
    return samples(spark, sf_dir).select("file", "name", "thread", "result")


@query("perf_log_info", """
SELECT 'perf-' || l_linestatus || '.log' AS file, 'MongoDB shell version: 2.7.5-pre-' AS client_version,
  'db version: 2.7.5' AS version, '2.7.5' AS server_version, '00112233445566778899aabbccddeeff00112233' AS git_sha,
  false AS conflict FROM lineitem WHERE l_linenumber = 1 GROUP BY l_linestatus""")
def perf_log_info(spark, sf_dir):
    return perf_log.perf_log_info(render.perf(spark, sf_dir))


@query("perf_mean_cv", PERF + """
SELECT file, name, thread, n, round(mean, 4) AS mean, round(cv, 4) AS cv FROM cvs""")
def perf_mean_cv(spark, sf_dir):
    return perf.mean_cv(samples(spark, sf_dir)).select(
        "file", "name", "thread", "n", F.round("mean", 4).alias("mean"), F.round("cv", 4).alias("cv"))


@query("perf_compare", PERF + """
SELECT key, round(old_mean, 4) AS old_mean, round(new_mean, 4) AS new_mean, round(ratio, 8) AS ratio,
  CASE WHEN old_mean IS NULL THEN key || chr(9) || 'n/a' || chr(9) || printf('%.6f', new_mean) || '[' || new_cv_str || ']' || chr(9) || 'n/a'
  ELSE key || chr(9) || printf('%.2f', old_mean) || '[' || old_cv_str || ']' || chr(9) || printf('%.2f', new_mean)
  || '[' || new_cv_str || ']' || chr(9) || delta END AS line FROM compared""")
def perf_compare(spark, sf_dir):
    lines = tables.tab_lines(tables.text_cells(compared(spark, sf_dir)))
    return lines.select("key", F.round("old_mean", 4).alias("old_mean"), F.round("new_mean", 4).alias("new_mean"),
                        F.round("ratio", 8).alias("ratio"), "line")


@query("perf_compare_wiki", PERF + """
SELECT key, CASE WHEN old_mean IS NULL THEN
  '||' || key || chr(9) || '|n/a' || chr(9) || '|' || printf('%.6f', new_mean) || chr(9) || '|[' || new_cv_str || ']' || chr(9) || '|n/a|'
  ELSE '||' || key || chr(9) || '|' || printf('%.2f', old_mean) || chr(9) || '|'
  || CASE WHEN old_noisy THEN '{color:orange}' || old_cv_str || '{color}' ELSE old_cv_str END || chr(9) || '|'
  || printf('%.2f', new_mean) || chr(9) || '|'
  || CASE WHEN new_noisy THEN '{color:orange}' || new_cv_str || '{color}' ELSE new_cv_str END || chr(9) || '|'
  || CASE WHEN regression THEN '{color:red}' || delta || '{color}' ELSE delta END || '|' END AS line FROM compared""")
def perf_compare_wiki(spark, sf_dir):
    return tables.tab_lines(tables.wiki_cells(compared(spark, sf_dir))).select("key", "line")


TABLE_CELLS = """
, cells AS (SELECT key, key AS c0, CASE WHEN old_mean IS NULL THEN 'n/a' ELSE printf('%.2f', old_mean) || '[' || old_cv_str || ']' END AS c1,
  CASE WHEN old_mean IS NULL THEN printf('%.6f', new_mean) ELSE printf('%.2f', new_mean) END || '[' || new_cv_str || ']' AS c2,
  CASE WHEN old_mean IS NULL THEN 'n/a' ELSE delta END AS c3 FROM compared
  UNION ALL VALUES ('', 'benchmark', 'old ns/op', 'new ns/op', 'delta')),
widths AS (SELECT max(length(c0)) + 5 AS w0, max(length(c1)) + 5 AS w1, max(length(c2)) + 5 AS w2 FROM cells)
"""


@query("perf_table", PERF + TABLE_CELLS + """
SELECT key, rpad(c0, CAST(w0 AS INTEGER), ' ') || rpad(c1, CAST(w1 AS INTEGER), ' ') || rpad(c2, CAST(w2 AS INTEGER), ' ') || c3 AS line
FROM cells, widths""")
def perf_table(spark, sf_dir):
    return tables.aligned_lines(tables.text_cells(compared(spark, sf_dir)), tables.TEXT_HEADER)


@query("perf_table_head", """
SELECT CASE f WHEN 'F' THEN 0 ELSE 1 END AS line_no, '# ' || CASE f WHEN 'F' THEN 'baseline' ELSE 'new results' END || ' : perf-' || f
  || '.log [db version: 2.7.5 | SHA: 00112233445566778899aabbccddeeff00112233]' AS value
FROM (SELECT DISTINCT l_linestatus AS f FROM lineitem WHERE l_linenumber = 1)""")
def perf_table_head(spark, sf_dir):
    return tables.head_lines(perf_log.perf_log_info(render.perf(spark, sf_dir)), render.OLD_PERF, render.NEW_PERF)


@query("perf_flags", PERF + "SELECT key, regression, old_noisy, new_noisy FROM compared")
def perf_flags(spark, sf_dir):
    return compared(spark, sf_dir).select("key", "regression", "old_noisy", "new_noisy")


@query("perf_reports", PERF + """
SELECT file AS run, 'mongo-perf' AS harness, name AS workload, '2.7.5' AS server_version,
  '00112233445566778899aabbccddeeff00112233' AS server_git_hash, CAST(thread AS VARCHAR) AS n_thread, cv_str AS cv,
  round(mean, 4) AS op_throughput FROM cvs""")
def perf_reports(spark, sf_dir):
    walked = perf_log.perf_lines(render.perf(spark, sf_dir))  # one walk for samples and head lines
    documents = report.perf_reports(perf.mean_cv(perf_log.samples_of(walked)), perf_log.info_of(walked))
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    return documents.select("run", "harness", "workload", "server_version", "server_git_hash", attribute("nThread").alias("n_thread"),
                            attribute("CV").alias("cv"), F.round("summary.all_nodes.op_throughput", 4).alias("op_throughput"))


@query("sim_reports", """
SELECT 'sim-' || c_custkey AS run, 'mongo-sim' AS harness, 'shop' AS workload, c_custkey AS run_seconds,
  CAST(c_nationkey AS VARCHAR) AS n_threads, CAST(2 AS BIGINT) AS nodes, CAST(c_custkey AS DOUBLE) AS first_latency,
  CAST(c_custkey % 7 AS DOUBLE) AS second_count FROM customer""")
def sim_reports(spark, sf_dir):
    lines = render.sim(spark, sf_dir)
    documents = report.sim_reports(captures.sim_run(lines), captures.sim_node_stats(lines))
    stat = lambda node, metric: F.get("summary.nodes", F.lit(node))["browse"][metric]
    return documents.select("run", "harness", "workload", "run_seconds", F.try_element_at("attributes", F.lit("nThreads")).alias("n_threads"),
                            F.size("summary.nodes").cast("bigint").alias("nodes"), stat(0, "op_lat_total_micros").alias("first_latency"),
                            stat(1, "op_count").alias("second_count"))


SYSBENCH_VALUES = """
  ('nThreads', substr(o_orderpriority, 1, 1)), ('nCollections', '15'), ('nCollectionSize', format('{:,}', n)),
  ('nFeedbackSeconds', '10'), ('nRunSeconds', '600'), ('oltp range size', '100'), ('oltp point selects', '10'),
  ('oltp simple ranges', '11'), ('oltp sum ranges', '12'), ('oltp order ranges', '13'), ('oltp distinct ranges', '14'),
  ('oltp index updates', '15'), ('oltp non index updates', '16'), ('write concern', 'SAFE')"""


@query("sysbench_params", f"""
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT 'sysbench-' || o_orderpriority AS file, param, CASE WHEN matches = 1 THEN value END AS value, matches,
  CASE matches WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status
FROM (SELECT *, CAST(CASE WHEN o_orderpriority LIKE '5%' AND param = 'nRunSeconds' THEN 0
  WHEN o_orderpriority LIKE '4%' AND param = 'write concern' THEN 2 ELSE 1 END AS BIGINT) AS matches
  FROM c, LATERAL (VALUES {SYSBENCH_VALUES}) v(param, value))""")
def sysbench_params(spark, sf_dir):
    return captures.parameters(render.sysbench(spark, sf_dir), "sysbench")


@query("sysbench_summary", """
SELECT 'sysbench-' || o_orderpriority AS file, arg_max(o_custkey, o_orderkey) + 0.25::DOUBLE AS throughput,
  count(*) AS n_intervals, substr(o_orderpriority, 1, 1) AS n_threads, format('{:,}', count(*)) AS collection_size,
  CASE WHEN o_orderpriority NOT LIKE '4%' THEN 'SAFE' END AS write_concern,
  CASE left(o_orderpriority, 1) WHEN '4' THEN 'write concern ambiguous' WHEN '5' THEN 'nRunSeconds missing' ELSE 'ok' END AS status
FROM orders GROUP BY o_orderpriority""")
def sysbench_summary(spark, sf_dir):
    return captures.summary(render.sysbench(spark, sf_dir), "sysbench").select(
        "file", "throughput", "n_intervals", F.col("nThreads").alias("n_threads"),
        F.col("nCollectionSize").alias("collection_size"), F.col("write concern").alias("write_concern"), "status")


@query("sysbench_trend", """
SELECT 'sysbench-' || o_orderpriority AS file, o_orderkey AS pos, o_custkey + 0.25::DOUBLE AS cum,
  o_totalprice AS "interval" FROM orders""")
def sysbench_trend(spark, sf_dir):
    return captures.intervals(render.sysbench(spark, sf_dir), "sysbench").select("file", "pos", "cum", "interval")


@query("sysbench_insert_summary", """
SELECT 'insert-' || c_mktsegment AS file, max(c_custkey) * 2 + 0.5::DOUBLE AS throughput, count(*) AS n_intervals,
  '8' AS n_threads, '16' AS n_collections, format('{:,}', count(*)) AS collection_size, '10' AS feedback,
  'SAFE' AS write_concern FROM customer GROUP BY c_mktsegment""")
def sysbench_insert_summary(spark, sf_dir):
    return captures.summary(render.sysbench_insert(spark, sf_dir), "sysbench-insert").select(
        "file", "throughput", "n_intervals", F.col("nThreads").alias("n_threads"),
        F.col("nCollections").alias("n_collections"), F.col("nCollectionSize").alias("collection_size"),
        F.col("nFeedbackSeconds").alias("feedback"), F.col("write concern").alias("write_concern"))


@query("sysbench_insert_trend", """
SELECT 'insert-' || c_mktsegment AS file, c_custkey AS pos, c_custkey * 2 + 0.5::DOUBLE AS cum,
  c_custkey + 0.75::DOUBLE AS "interval" FROM customer""")
def sysbench_insert_trend(spark, sf_dir):
    return captures.intervals(render.sysbench_insert(spark, sf_dir), "sysbench-insert").select(
        "file", "pos", "cum", "interval")


@query("hammer_summary", """
SELECT 'hammer-' || event_type AS file, CAST(count(*) AS DOUBLE) AS throughput, count(*) AS n_intervals,
  CAST(count(DISTINCT user_id) AS VARCHAR) AS n_threads, CAST(max(CAST(value AS DECIMAL(18, 2))) AS VARCHAR) AS avg_response,
  '10.00' AS error_ratio, '18.00' AS slow_ratio FROM events GROUP BY event_type""")
def hammer_summary(spark, sf_dir):
    return captures.summary(render.hammer(spark, sf_dir), "hammer").select(
        "file", "throughput", "n_intervals", F.col("nThreads").alias("n_threads"),
        F.col("avgResponseTime").alias("avg_response"), F.col("errorRatio").alias("error_ratio"),
        F.col("slowRatio").alias("slow_ratio"))


@query("hammer_trend", """
SELECT 'hammer-' || event_type AS file, event_id AS pos, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS avg,
  CAST(event_id AS DOUBLE) AS send FROM events""")
def hammer_trend(spark, sf_dir):
    return captures.intervals(render.hammer(spark, sf_dir), "hammer").select("file", "pos", "avg", "send")


@query("ycsb_summary", """
SELECT 'ycsb-' || c_nationkey AS file, min(c_custkey) FILTER (c_custkey % 2 = 1) + 0.25::DOUBLE AS throughput,
  'Command line: -db client -s -P workloads/w -threads ' || coalesce(min(c_custkey) FILTER (c_custkey % 2 = 1), max(c_custkey)) AS command_line
FROM customer GROUP BY c_nationkey""")
def ycsb_summary(spark, sf_dir):
    return captures.ycsb_summary(render.ycsb(spark, sf_dir))


@query("sim_node_stats", """
SELECT 'sim-' || c_custkey AS file, node_no, 'browse' AS node, metric, CAST(value AS DOUBLE) AS value
FROM customer, LATERAL (VALUES (0, 'op_count', c_nationkey), (0, 'op_lat_total_micros', c_custkey),
  (1, 'op_count', c_custkey % 7), (1, 'op_lat_total_micros', c_custkey * 2)) v(node_no, metric, value)""")
def sim_node_stats(spark, sf_dir):
    return captures.sim_node_stats(render.sim(spark, sf_dir))


@query("sim_run", """
SELECT 'sim-' || c_custkey AS file, 'mongo-sim' AS harness, 'shop' AS workload, c_custkey AS run_seconds,
  CAST(c_nationkey AS VARCHAR) AS n_threads FROM customer""")
def sim_run(spark, sf_dir):
    return captures.sim_run(render.sim(spark, sf_dir)).select(
        "file", "harness", "workload", "run_seconds", F.try_element_at("attributes", F.lit("nThreads")).alias("n_threads"))


BLOCKS = """
WITH blocks AS (
  SELECT *, 'pidstat-10.0.0.' || (user_id % 4) AS file,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS sample,
    count(*) OVER (PARTITION BY user_id % 4) AS total FROM events),
kept AS (SELECT * FROM blocks WHERE sample >= 10 AND sample < total - 10)
"""


@query("pidstat_series", BLOCKS + """
SELECT file, CAST(sample AS INTEGER) AS sample, event_id AS ts, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS cpu,
  user_id + 0.25::DOUBLE AS mem, CAST(event_id % 1000 AS DOUBLE) AS kb_rd, event_id % 777 + 0.5::DOUBLE AS kb_wr,
  CAST(3 * user_id + 3 AS DOUBLE) AS cswch, CAST(3 * (event_id % 100) + 3 AS DOUBLE) AS nvcswch FROM kept""")
def pidstat_series(spark, sf_dir):
    return pidstat.pidstat_series(render.pidstat(spark, sf_dir))


@query("pidstat_process", BLOCKS + "SELECT DISTINCT file, 'serverd' AS process FROM kept")
def pidstat_process(spark, sf_dir):
    return pidstat.pidstat_process(render.pidstat(spark, sf_dir))


@query("csv_tail_summary", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer)
SELECT 'csv-' || n_nationkey AS file, CASE WHEN c.n IS NOT NULL THEN 'key,name,balance' END AS header,
  c_custkey || ',' || c_name || ',' || CAST(c_acctbal AS DECIMAL(18, 2)) AS last_row, c.n IS NULL AS missing
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c.c_nationkey = n_nationkey
  LEFT JOIN ranked ON ranked.c_nationkey = n_nationkey AND r = 2""")
def csv_tail_summary(spark, sf_dir):
    expected = render.table(spark, sf_dir, "nation").select(render.text("csv-", F.col("n_nationkey")).alias("file"))
    return csv_tail.csv_tail_summary(render.csv(spark, sf_dir), expected).drop("unbalanced")


@query("server_info", """
SELECT s_name AS server, s_name AS hostname, s_suppkey * 16 + 1024 AS mem_mb, CAST(s_nationkey + 1 AS BIGINT) AS cores,
  s_suppkey + 4096 AS page_size, '2.6.' || s_nationkey AS version, 64 AS bits,
  CASE WHEN s_suppkey % 3 = 0 THEN 'mmapv0' ELSE 'wiredTiger' END AS storage_engine FROM supplier""")
def server_info(spark, sf_dir):
    return shell_json.parse_server_info(render.server_snapshots(spark, sf_dir)).select(
        "server", "host.system.hostname", F.col("host.system.memSizeMB").alias("mem_mb"),
        F.col("host.system.numCores").alias("cores"), F.col("host.extra.pageSize").alias("page_size"),
        "build.version", "build.bits", "storage_engine")


COSTS = """
WITH costs AS (
  SELECT o_orderkey AS run, o_custkey + 7 + o_orderkey % 11 AS total_ops, o_custkey % 13 AS utime, o_orderkey % 5 AS stime,
    60000 + o_custkey AS run_ms FROM orders)
"""


def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.run_costs(counters.parse_snapshots(render.run_snapshots(spark, sf_dir)))


@query("opcounter_delta", COSTS + "SELECT run, total_ops FROM costs")
def opcounter_delta(spark, sf_dir):
    return run_costs(spark, sf_dir).select("run", "total_ops")


@query("ticks_per_op", COSTS + """
SELECT run, utime, stime, run_ms, CAST(utime + stime AS DOUBLE) / total_ops AS ticks_per_op FROM costs""")
def ticks_per_op(spark, sf_dir):
    return run_costs(spark, sf_dir).select("run", "utime", "stime", "run_ms", "ticks_per_op")


def sysbench_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = runs.results(render.sysbench(spark, sf_dir), "sysbench")
    own = F.create_map(F.lit("run-by"), F.lit("nightly"), F.lit("nThreads"), F.lit("unknown"))
    configured = render.table(spark, sf_dir, "orders").select(
        render.text("sysbench-", F.col("o_orderpriority")).alias("run")).distinct().select(
        "run", F.lit("sysbench").alias("harness"), own.alias("attributes"))
    costs = counters.run_costs(counters.parse_snapshots(render.sysbench_snapshots(spark, sf_dir)))
    return report.run_reports(configured, results, costs)


@query("harness_results", """
SELECT 'sysbench-' || o_orderpriority AS run, 'sysbench' AS harness, 'sysbench-' || o_orderpriority AS workload,
  arg_max(o_custkey, o_orderkey) + 0.25::DOUBLE AS throughput, substr(o_orderpriority, 1, 1) AS n_threads
FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'insert-' || c_mktsegment, 'sysbench', 'insert-' || c_mktsegment, max(c_custkey) * 2 + 0.5::DOUBLE, '8'
FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'hammer-' || event_type, 'hammer', 'hammer-' || event_type, count(*), CAST(count(DISTINCT user_id) AS VARCHAR)
FROM events GROUP BY event_type
UNION ALL SELECT 'ycsb-' || c_nationkey, 'ycsb', 'ycsb-' || c_nationkey, min(c_custkey) FILTER (c_custkey % 2 = 1) + 0.25::DOUBLE, NULL
FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'sim-' || c_custkey, 'mongo-sim', 'sim-' || c_custkey, NULL, CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'perf-' || l_linestatus || '.log', 'mongo-perf', 'Item.' || l_returnflag, round(avg(l_extendedprice), 4),
  CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linestatus <> 'F' OR l_linenumber <> 7
GROUP BY l_linestatus, l_returnflag, l_linenumber""")
def harness_results(spark, sf_dir):
    """Captures of every tool through one switch on the harness type."""
    logs = {"sysbench": render.sysbench, "sysbench-insert": render.sysbench_insert, "hammer": render.hammer,
            "ycsb": render.ycsb, "mongo-sim": render.sim, "mongo-perf": render.perf}
    both = None
    for harness, rendered in logs.items():
        found = runs.results(rendered(spark, sf_dir), harness)
        both = found if both is None else both.unionByName(found)
    n_threads = F.coalesce(F.try_element_at("attributes", F.lit("nThreads")), F.try_element_at("attributes", F.lit("nThread")))
    return both.select("run", "harness", "workload", F.round("throughput", 4).alias("throughput"), n_threads.alias("n_threads"))


@query("run_report", """
SELECT 'sysbench-' || o_orderpriority AS run, 'sysbench' AS harness, 'sysbench-' || o_orderpriority AS workload,
  'nightly' AS run_by, substr(o_orderpriority, 1, 1) AS n_threads, CASE WHEN o_orderpriority NOT LIKE '4%' THEN 'SAFE' END AS write_concern,
  arg_max(o_custkey, o_orderkey) + 0.25::DOUBLE AS op_throughput, count(*) AS utime, count(*) * 2 AS stime,
  CAST(count(*) + sum(o_custkey) AS BIGINT) AS total_ops,
  CAST(count(*) * 3 AS DOUBLE) / CAST(count(*) + sum(o_custkey) AS BIGINT) AS tick_per_op, count(*) * 10 AS test_run_time
FROM orders GROUP BY o_orderpriority""")
def run_report(spark, sf_dir):
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    return sysbench_reports(spark, sf_dir).select(
        "run", "harness", "workload", attribute("run-by").alias("run_by"), attribute("nThreads").alias("n_threads"),
        attribute("write concern").alias("write_concern"), "summary.all_nodes.op_throughput", "utime", "stime",
        "total_ops", "tick_per_op", "test_run_time")


RUN_DOCUMENT = """testbed STRUCT<type: STRING, servers: STRUCT<mongod: ARRAY<STRUCT<server: STRING>>, mongos: ARRAY<STRUCT<server: STRING>>,
  config: ARRAY<STRUCT<server: STRING, storageEngine: STRUCT<name: STRING>>>>>, summary STRUCT<all_nodes: STRUCT<op_throughput: DOUBLE>>, total_ops BIGINT,
  History ARRAY<DOUBLE>, server_stats MAP<STRING, STRUCT<`process `: STRING, ts: ARRAY<BIGINT>, cpu: ARRAY<DOUBLE>, cswch: ARRAY<DOUBLE>, nvcswch: ARRAY<DOUBLE>>>"""


@query("run_documents", BLOCKS + """
, series AS (SELECT user_id % 4 + 1 AS digit, count(*) AS samples, min(event_id) AS first_ts, max(event_id) AS last_ts,
  CAST(sum(3 * user_id + 3) AS DOUBLE) AS switches FROM kept GROUP BY 1),
beds AS (SELECT s_suppkey % 5 + 1 AS digit, count(*) FILTER (s_suppkey % 3 = 0) AS n_mongod, count(*) FILTER (s_suppkey % 3 = 1) AS n_mongos,
  count(*) FILTER (s_suppkey % 3 = 2) AS n_config, min(s_name) FILTER (s_suppkey % 3 = 0) AS first_mongod FROM supplier GROUP BY 1),
runs AS (SELECT o_orderpriority, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit, arg_max(o_custkey, o_orderkey) + 0.25::DOUBLE AS op_throughput,
  CAST(count(*) + sum(o_custkey) AS BIGINT) AS total_ops, count(*) AS points, arg_min(o_totalprice, o_orderkey) AS first_point,
  arg_max(o_totalprice, o_orderkey) AS last_point FROM orders GROUP BY 1)
SELECT 'sysbench-' || o_orderpriority AS run, 'cluster' AS bed, coalesce(n_mongod, 0) AS n_mongod, coalesce(n_mongos, 0) AS n_mongos,
  coalesce(n_config, 0) AS n_config, first_mongod, op_throughput, total_ops, points, first_point, last_point,
  CASE WHEN samples IS NOT NULL THEN '10_0_0_' || (digit - 1) END AS server, CASE WHEN samples IS NOT NULL THEN 'serverd' END AS process,
  samples, first_ts, last_ts, switches FROM runs LEFT JOIN series USING (digit) LEFT JOIN beds USING (digit)""")
def run_documents(spark, sf_dir):
    """Whole documents: report, test bed, interval history and server series, written page by page and read back."""
    digit_of = lambda run: F.regexp_extract(run, "^sysbench-([0-9])", 1)
    reports = sysbench_reports(spark, sf_dir)
    names = reports.select("run", digit_of(F.col("run")).alias("digit"))
    servers = shell_json.parse_server_info(render.server_snapshots(spark, sf_dir)).join(
        render.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("server"), (F.col("s_suppkey") % 5 + 1).cast("string").alias("digit"),
                                                       F.element_at(F.array(*map(F.lit, report.ROLES)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("role")), "server").join(names, "digit")
    beds = report.with_test_bed(reports, reports.select("run", F.lit("cluster").alias("type")), servers)
    history = report.series_pages(captures.intervals(render.sysbench(spark, sf_dir), "sysbench"), "interval")
    captured = render.pidstat(spark, sf_dir)
    server_of = lambda file: F.regexp_extract(file, "^pidstat-(.*)$", 1)
    of_run = names.withColumn("file", F.concat(F.lit("pidstat-10.0.0."), (F.col("digit").cast("int") - 1).cast("string")))
    series = pidstat.pidstat_series(captured).join(of_run, "file")
    pages = report.server_pages(series, server_of(F.col("file")), run=F.col("run"))
    processes = pidstat.pidstat_process(captured).join(of_run, "file").select("run", report.server_key(server_of(F.col("file"))).alias("server"), "process")
    folder = scratch_dir(spark, "run-documents")
    written = report.write_run_documents(report.document_pieces(beds, history, pages, processes), folder)
    read = spark.read.text(folder, wholetext=True).select(F.from_json("value", RUN_DOCUMENT).alias("d"), F.col("_metadata.file_name").alias("name"))
    documents = written.select("run", F.regexp_extract("file", "([^/]+)$", 1).alias("file")).join(read, F.url_decode("name") == F.url_decode("file"))
    size = lambda role: F.size(f"d.testbed.servers.{role}").cast("bigint").alias(f"n_{role}")
    one = documents.select("run", "d", F.explode_outer("d.server_stats").alias("server", "stats"))
    return one.select(
        "run", F.col("d.testbed.type").alias("bed"), *[size(role) for role in report.ROLES], F.get("d.testbed.servers.mongod.server", F.lit(0)).alias("first_mongod"),
        "d.summary.all_nodes.op_throughput", "d.total_ops", F.size("d.History").cast("bigint").alias("points"), F.element_at("d.History", 1).alias("first_point"),
        F.element_at("d.History", -1).alias("last_point"), "server", F.col("stats.`process `").alias("process"), F.size("stats.ts").cast("bigint").alias("samples"),
        F.element_at("stats.ts", 1).alias("first_ts"), F.element_at("stats.ts", -1).alias("last_ts"),
        F.aggregate("stats.cswch", F.lit(0.0), lambda a, b: a + b).alias("switches"))


@query("run_series_pages", """
SELECT 'sysbench-' || o_orderpriority AS run, o_orderkey // 16384 AS page, count(*) AS points,
  arg_min(o_totalprice, o_orderkey) AS first_interval, arg_max(o_totalprice, o_orderkey) AS last_interval
FROM orders GROUP BY ALL""")
def run_series_pages(spark, sf_dir):
    pages = report.series_pages(captures.intervals(render.sysbench(spark, sf_dir), "sysbench"), "cum", "interval")
    at = lambda i: F.element_at("interval", i)
    return pages.select(F.col("file").alias("run"), "page", F.size("interval").cast("bigint").alias("points"),
                        at(1).alias("first_interval"), at(-1).alias("last_interval"))


@query("server_stats_pages", BLOCKS + """
SELECT replace(file, '.', '_') AS server, sample // 10000 AS page, count(*) AS points, min(event_id) AS first_ts,
  max(event_id) AS last_ts FROM kept GROUP BY ALL""")
def server_stats_pages(spark, sf_dir):
    pages = report.server_pages(pidstat.pidstat_series(render.pidstat(spark, sf_dir)), F.col("file"))
    return pages.select("server", "page", F.size("ts").cast("bigint").alias("points"),
                        F.element_at("ts", 1).alias("first_ts"), F.element_at("ts", -1).alias("last_ts"))


# ---------------------------------------------------------------- keyed sums

TOTALS = """
WITH totals AS (
  SELECT o_custkey AS _id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY 1)
"""
JOBS = 8


def totals(rows: DataFrame) -> DataFrame:
    return keyed_sum.keyed_reduce(rows, F.col("uid"), F.col("amount"))


def concurrent_totals(rows: DataFrame) -> DataFrame:
    return keyed_sum.merge_totals(*[totals(rows) for _ in range(JOBS)])


@query("mr_totals", TOTALS + "SELECT _id, value FROM totals")
def mr_totals(spark, sf_dir):
    return totals(render.amounts(spark, sf_dir))


@query("mr_totals_concurrent", TOTALS + "SELECT _id, value * 8 AS value FROM totals")
def mr_totals_concurrent(spark, sf_dir):
    return concurrent_totals(render.amounts(spark, sf_dir))


@query("mr_merge_totals", TOTALS + "SELECT _id, value FROM totals")
def mr_merge_totals(spark, sf_dir):
    rows = render.amounts(spark, sf_dir)
    stored = totals(rows.where("status = 'F'"))
    return keyed_sum.merge_totals(stored, totals(rows.where("status <> 'F'")))


@query("mr_stored_totals", TOTALS + "SELECT _id, value FROM totals")
def mr_stored_totals(spark, sf_dir):
    rows = render.amounts(spark, sf_dir)
    store = keyed_sum.StoredTotals(spark, scratch_dir(spark, "totals"))
    store.merge(totals(rows.where("status = 'F'")), 0)
    store.merge(totals(rows.where("status <> 'F'")), 1)
    store.merge(totals(rows.where("status <> 'F'")), 1)
    return store.read()


@query("mr_compacted_totals", TOTALS + "SELECT _id, value FROM totals")
def mr_compacted_totals(spark, sf_dir):
    """A compacted store goes on with a job that counts its batches from 0 again."""
    rows = render.amounts(spark, sf_dir)
    store = keyed_sum.StoredTotals(spark, scratch_dir(spark, "totals"))
    store.merge(totals(rows.where("status = 'F'")), 0)
    compacted = store.compact(scratch_dir(spark, "totals"))
    compacted.merge(totals(rows.where("status <> 'F'")), 0)
    return compacted.read()


@query("mr_two_jobs", TOTALS + "SELECT _id, value * 2 AS value FROM totals")
def mr_two_jobs(spark, sf_dir):
    rows = render.amounts(spark, sf_dir)
    store = keyed_sum.StoredTotals(spark, scratch_dir(spark, "totals"))
    for job in ("one", "two"):
        store.merge(totals(rows), 0, job)
    return store.read()


@query("mr_stored_max", """
SELECT o_custkey AS _id, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS value FROM orders GROUP BY 1""")
def mr_stored_max(spark, sf_dir):
    rows = render.amounts(spark, sf_dir)
    store = keyed_sum.StoredTotals(spark, scratch_dir(spark, "totals"), reducer="max")
    largest = lambda part: keyed_sum.keyed_reduce(part, F.col("uid"), F.col("amount"), F.max)
    store.merge(largest(rows.where("status = 'F'")), 0)
    store.merge(largest(rows.where("status <> 'F'")), 1)
    return store.read()


@query("mr_user_reduce", """
SELECT o_custkey AS _id, list_reduce(list(CAST(round(o_totalprice * 100) AS BIGINT)), lambda a, b: gcd(a, b)) AS value FROM orders GROUP BY 1""")
def mr_user_reduce(spark, sf_dir):
    """A Python function that no aggregate offers, merged over three batches, one of them replayed."""
    fold = lambda part: user_reduce.merge_by_key(part, math.gcd)
    store = keyed_sum.StoredTotals(spark, scratch_dir(spark, "totals"), "gcd", fold)
    rows = render.amounts(spark, sf_dir)
    for batch, status in enumerate(("F", "O", "P", "P")):
        part = user_reduce.reduce_by_key(rows.where(F.col("status") == status), F.col("uid"), F.col("amount"), math.gcd)
        store.merge(part, min(batch, 2))
    return store.read()


PRIME = 1_000_003


@query("mr_sql_reduce", f"""
SELECT o_custkey AS _id, list_reduce(list(CAST(round(o_totalprice * 100) AS BIGINT) % {PRIME}), lambda a, b: (a * b) % {PRIME}) AS value
FROM orders GROUP BY 1 UNION ALL
SELECT -1, list_reduce(list(CAST(round(o_totalprice * 100) AS BIGINT) % {PRIME}), lambda a, b: (a * b) % {PRIME}) FROM orders""")
def mr_sql_reduce(spark, sf_dir):
    """A product modulo a prime for each customer, and for one key that has all rows."""
    rows = render.amounts(spark, sf_dir).withColumn("uid", F.explode(F.array("uid", F.lit(-1).cast("bigint"))))
    values = rows.select(F.col("uid").alias("_id"), (F.col("amount") % PRIME).alias("value"))
    return user_reduce.merge_by_key_sql(values, lambda a, b: a * b % PRIME)


@query("mr_check_planted", TOTALS + """
SELECT _id, value AS single, CASE WHEN _id % 7 <> 0 THEN value + 1 END AS merged FROM totals WHERE _id % 7 = 0 OR _id % 7 = 1""")
def mr_check_planted(spark, sf_dir):
    """The check finds totals that are off by one and totals that are gone."""
    rows = totals(render.amounts(spark, sf_dir))
    off = rows.where("_id % 7 <> 0").withColumn("value", F.col("value") + (F.col("_id") % 7 == 1).cast("int"))
    return keyed_sum.check_totals(rows, off, 1)


@query("mr_check", TOTALS + "SELECT _id, value AS single, value AS merged FROM totals WHERE value <> value")
def mr_check(spark, sf_dir):
    rows = render.amounts(spark, sf_dir)
    return keyed_sum.check_totals(totals(rows), concurrent_totals(rows), JOBS)


@query("mr_check_partial", TOTALS + """
, part AS (SELECT o_custkey AS _id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT _id, totals.value AS single, part.value AS merged FROM totals LEFT JOIN part USING (_id)
WHERE part.value IS DISTINCT FROM totals.value""")
def mr_check_partial(spark, sf_dir):
    """The check finds every key whose pending orders were left out."""
    rows = render.amounts(spark, sf_dir)
    return keyed_sum.check_totals(totals(rows), totals(rows.where("status <> 'P'")), 1)


# ---------------------------------------------------------------- generated data

SHAPE = {"cid": "ObjectId", "cre": ["rand-int", "lte"], "status": "string", "b": {"b1": "int", "b2": "int"}}


@query("gen_docs", """
SELECT o_orderkey AS _id, 'ObjectId(' || o_orderkey || ')' AS cid, true AS cre_ok, 'string_' || o_orderkey AS status,
  o_orderkey AS b1, o_orderkey AS b2 FROM orders""")
def gen_docs(spark, sf_dir):
    docs = synth.documents_for(render.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SHAPE)
    return docs.select("_id", "cid", F.col("cre").between(0, 999).alias("cre_ok"), "status", "b.b1", "b.b2")




def random_sql(limit: int, *parts: str) -> str:
    """The generators' random numbers below ``limit``; a part is an expression, or a name in double quotes."""
    h = "1::BIGINT"
    for part in parts:
        number = str(synth.name_number(part.strip('"'))) if part.startswith('"') else f"((({part}) % {synth.PRIME} + {synth.PRIME}) % {synth.PRIME})"
        h = f"(({h} * {synth.MULTIPLIER} + {number}) % {synth.PRIME})"
    return f"[(h * h + h * {synth.MULTIPLIER} + 11) % {synth.PRIME} % {limit} for h in [{h}]][1]"


@query("gen_docs_stored", f"""
SELECT o_orderkey AS _id, 'ObjectId(' || o_orderkey || ')' AS cid, {random_sql(1000, "o_orderkey", '"cre"', "0")} AS cre,
  'string_' || o_orderkey AS status, o_orderkey AS b1 FROM orders""")
def gen_docs_stored(spark, sf_dir):
    """Generated documents, written in bulk and read back, with their random values."""
    folder = scratch_dir(spark, "documents")
    docs = synth.documents_for(render.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SHAPE)
    synth.write_documents(docs, folder)
    return spark.read.parquet(folder).select("_id", "cid", "cre", "status", "b.b1")


@query("gen_staging_amounts", f"""
SELECT c_custkey AS uid, CAST(w AS INTEGER) AS writer, CAST(s AS INTEGER) AS status,
  {random_sql(1_000_000, "c_custkey", "w", "s", "0")} AS amount FROM customer, range(10) a(w), range(5) b(s)""")
def gen_staging_amounts(spark, sf_dir):
    return synth.staging_rows(render.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("uid", "writer", "status", "amount")


@query("gen_predicates", """
SELECT o_orderkey AS _id, 'ObjectId(' || o_orderkey || ')' AS cid, true AS bound_ok, 'string_' || o_orderkey AS status
FROM orders""")
def gen_predicates(spark, sf_dir):
    docs = synth.documents_for(render.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SHAPE, query=True)
    return docs.select("_id", "cid", F.col("cre").getField("$lte").between(0, 999).alias("bound_ok"), "status")


@query("gen_staging", """
SELECT c_custkey AS uid, CAST(w AS INTEGER) AS writer, CAST(s AS INTEGER) AS status, true AS amount_ok
FROM customer, range(10) a(w), range(5) b(s)""")
def gen_staging(spark, sf_dir):
    rows = synth.staging_rows(render.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return rows.select("uid", "writer", "status", F.col("amount").between(0, 999_999).alias("amount_ok"))


# ---------------------------------------------------------------- streams

def _stream_input(lines: DataFrame, label: str) -> str:
    """Lines as four files in no order; the streams take one file at a time."""
    folder = scratch_dir(lines.sparkSession, label)
    lines.select("value").repartition(4, F.xxhash64("value")).write.text(os.path.join(folder, "in"))
    return folder


@query("stream_ops_per_second", EV + "SELECT epoch, op, count(*) AS n FROM log WHERE op IS NOT NULL GROUP BY epoch, op")
def stream_ops_per_second(spark, sf_dir):
    folder = _stream_input(render.dblog(spark, sf_dir), "stream-ops")
    out, checkpoint = os.path.join(folder, "out"), os.path.join(folder, "checkpoint")
    jobs.ops_per_second_stream(jobs.follow_lines(spark, os.path.join(folder, "in"), 1), out, checkpoint).awaitTermination()
    return jobs.read_rates(spark, out)


@query("stream_mr_totals", TOTALS + "SELECT _id, value FROM totals")
def stream_mr_totals(spark, sf_dir):
    folder = scratch_dir(spark, "stream-totals")
    source, out, checkpoint = (os.path.join(folder, name) for name in ("in", "out", "checkpoint"))
    render.amounts(spark, sf_dir).select("uid", "amount").write.parquet(source)
    rows = spark.readStream.schema("uid BIGINT, amount BIGINT").parquet(source)
    jobs.totals_stream(rows, "uid", "amount", out, checkpoint).awaitTermination()
    return keyed_sum.StoredTotals(spark, out).read()


@query("stream_unique_agents", ACCESS + "SELECT DISTINCT agent_id FROM log WHERE agent_id IS NOT NULL")
def stream_unique_agents(spark, sf_dir):
    folder = _stream_input(render.access(spark, sf_dir), "stream-agents")
    out, checkpoint = os.path.join(folder, "out"), os.path.join(folder, "checkpoint")
    jobs.agents_stream(jobs.follow_lines(spark, os.path.join(folder, "in"), 1), out, checkpoint).awaitTermination()
    return jobs.read_agents(spark, out)


STREAM_RATES = EV + "SELECT epoch, op, count(*) AS n FROM log WHERE op IS NOT NULL GROUP BY epoch, op"


@query("stream_windowed_rates", STREAM_RATES)
def stream_windowed_rates(spark, sf_dir):
    """Rates with the open seconds in the state store; files in no order, so most lines are late."""
    folder = _stream_input(render.dblog(spark, sf_dir), "stream-windows")
    out, checkpoint = os.path.join(folder, "out"), os.path.join(folder, "checkpoint")
    jobs.windowed_rates(jobs.follow_lines(spark, os.path.join(folder, "in"), 1), out, checkpoint)
    return jobs.read_windowed_rates(spark, out, checkpoint)


@query("stream_growing_log", STREAM_RATES)
def stream_growing_log(spark, sf_dir):
    """Logs of eight servers that grow between two runs; the first run ends in the middle of a line of each."""
    folder = scratch_dir(spark, "growing-logs")
    source, out, checkpoint = (os.path.join(folder, name) for name in ("in", "out", "checkpoint"))
    lines = render.dblog(spark, sf_dir, file=render.text("server-", F.col("user_id") % 8, ".log"))
    for upto in (lines.agg((F.max("pos") * 0.6).cast("bigint")).first()[0], None):
        render.write_log_files(lines, source, upto)
        jobs.windowed_rates(follow_growing(spark, source, "*.log"), out, checkpoint, delay=3600)
    return jobs.read_windowed_rates(spark, out, checkpoint)


@query("stream_recent_agents", ACCESS + "SELECT DISTINCT agent_id FROM log WHERE agent_id IS NOT NULL")
def stream_recent_agents(spark, sf_dir):
    folder = _stream_input(render.access(spark, sf_dir), "recent-agents")
    out, checkpoint = os.path.join(folder, "out"), os.path.join(folder, "checkpoint")
    jobs.recent_agents(jobs.follow_lines(spark, os.path.join(folder, "in"), 1), out, checkpoint).awaitTermination()
    return jobs.read_agents(spark, out)
