import json
import random

import pytest
from pyspark.sql import functions as F

from opslens.functions import predicates
from opslens.functions.shapes import _by_names, shape_of, shape_of_skeleton
from shape_by_hand import canonical_shape
from opslens.operators import workload
from opslens.plans import render
from opslens.sinks import events as event_store
from opslens.sources import dblog

# The words of a log line, and the time below, whose second has to come out as 1402003513.
TAIL = "ntoskip:0 keyUpdates:0 reslen:41 3ms"
SECOND = "2014-06-05T14:25:13"
# Lines of our own.
ALERTS = (f'{SECOND}.101-0700 [conn11] query depot.stock.low query: {{ $query: {{ state: "EMPTY", aisle: ObjectId(\'0a1b2c3d4e5f60718293a4b5\'), '
          f"due: {{ $lte: new Date(1700000000123) }} }}, $orderby: {{ due: -1 }} }} planSummary: IXSCAN {{ aisle: 1 }} ntoreturn:7 {TAIL}")
JOBS = f"{SECOND}.102+0000 [conn12] query depot.tasks planSummary: COLLSCAN ntoreturn:3 {TAIL}"
HOURS = f'{SECOND}.103+0000 [conn13] update depot.counters query: {{ _id: "gate-7" }} update: {{ $inc: {{ in.3.n: 2, in.3.kg: 515 }} }} nscanned:1 {TAIL}'
USERS = f"{SECOND}.104-0700 [conn14] query library.readers query: {{ $query: {{ card: 5120 }} }} planSummary: IXSCAN {{ card: 1 }} {TAIL}"
FOLLOWING = f"{SECOND}.105-0700 [conn15] query library.readers query: {{ $query: {{ borrowed: {{ $in: [ 61 ] }} }} }} planSummary: COLLSCAN cursorid:5 {TAIL}"
ACCEPTED = f"{SECOND}.106-0700 [listener] connection accepted from 10.9.8.7:40000 #14"
COMMAND = "2014-06-05T14:25:14.000-0700 [conn16] command gate.$cmd command: isMaster { isMaster: 1 } reslen:90 0ms"
REPLACED = "2014-06-05T14:25:14.100-0700 [conn16] update library.readers query: { _id: 3 } update: { seat: 4 } nscanned:1 0ms"


def read(lines, *texts, **options):
    events = dblog.with_shapes(dblog.with_predicates(dblog.parse_dblog(lines(list(texts)), **options)))
    return events.orderBy("pos").collect()


def test_events(lines):
    alerts, jobs, hours, users, following, accepted, command, replaced = read(
        lines, ALERTS, JOBS, HOURS, USERS, FOLLOWING, ACCEPTED, COMMAND, REPLACED)
    assert alerts.q_norm == ":$orderby<:fieldname>:$query<:fieldname:fieldname<:$lte>:fieldname>&IXSCAN"
    assert json.loads(alerts.q_json)["OP_query"]["due"] == {"OP_lte": "new-Date(1700000000123)"}
    assert (jobs.q_norm, jobs.q_plan, jobs.q_json) == ("$COLLSCAN", None, '{"COLLSCAN":"COLLSCAN"}')
    assert (hours.update_norm, hours.q_norm) == (":$inc<:fieldname:fieldname>", ":_id")
    assert (users.epoch, users.q_plan, users.conn, users.ns) == (1402003513, "IXSCAN", "[conn14]", "library.readers")
    assert json.loads(users.q_json) == {"OP_query": {"card": "5120"}}
    assert following.q_norm == ":$query<:fieldname<:$in>>&COLLSCAN"
    assert following.q_string == "{ OP_query: { borrowed: { OP_in: [ 61 ] } } }"
    assert json.loads(following.q_json) == {"OP_query": {"borrowed": {"OP_in": ["61"]}}}
    assert (accepted.parse_status, accepted.op, accepted.raw) == ("skipped", None, ACCEPTED)
    assert (command.op, command.cmd) == ("command", "isMaster")
    assert json.loads(replaced.update_json) == {"seat": "4"}


def test_decoded_operations(lines):
    change = "2014-06-05T14:25:14.100-0700 [conn5] update a.b query: { _id: 1 } update: { %s } nscanned:1 0ms"
    bodies = ["$set: { a: 1 }, $inc: { b: 1 }", "$pull: { a: 1 }", "$push: { a: { $inc: 1 } }", "x: 1", "$set: { a: 1 }"]
    events = dblog.parse_dblog(lines([change % body for body in bodies]))
    got = [r.op_read for r in events.withColumn("op_read", dblog.op_read()).orderBy("pos").collect()]
    assert got == ["update-$inc", "update-$pull", "updateupdate", "updateupdate", "update-$set"]


def test_broken_and_odd_lines(lines):
    rows = read(
        lines, "", "x", "2014-06-05T14:25:14.100-0700 [c] query a.b query: { a: 1 planSummary: X 0ms",
        "yesterday [c] insert a.b ninserted:1 0ms",
        "2014-06-05T14:25:14.100-0700 [c] update a.b query: { a: 1 } nscanned:1 0ms",
        "2014-06-05T14:25:14.100-0700 [c] getmore a.b cursorid:1 0ms",
        '2014-06-05T14:25:14.100-0700 [c] query a.b query: { a: "two } words: , here", b: 1 } planSummary: EOF 0ms',
        "2014-06-05T14:25:14.100-0700 [c] query a.b query: {} planSummary: EOF 0ms")
    assert [r.parse_status for r in rows] == ["skipped", "skipped", "unreadable", "error", "unreadable", "ok", "ok", "ok"]
    assert [(r.op, r.ns) for r in rows[2:5]] == [("query", "a.b"), (None, None), ("update", "a.b")]
    assert rows[2].epoch == 1402003514 and (rows[2].q_text, rows[4].update_text) == (None, None)
    assert json.loads(rows[6].q_json) == {"a": "two } words: , here", "b": "1"}
    assert rows[6].q_norm == ":fieldname:fieldname&EOF"
    assert rows[7].q_norm == "&EOF"


def test_strict_mode_drops_strings_with_blanks(lines):
    text = '2014-06-05T14:25:14.100-0700 [c] query a.b query: { a: "two words" } planSummary: EOF 0ms'
    plain = '2014-06-05T14:25:14.100-0700 [c] query a.b query: { a: "one", b: "two" } planSummary: EOF 0ms'
    assert [r.parse_status for r in read(lines, text, plain, strict_reference=True)] == ["error", "ok"]


# The shapes on the right; the documents are our own.
SHAPES = {
    '{ query: { $and: [ { opens: { $lte: 17 } }, { kind: "A" } ] }, orderby: { row: 1, seat: -1 } }':
        "$orderby<:fieldname:fieldname>$query<:$and[:fieldname<:$lte>:fieldname]>",
    "{ $query: { borrowed: { $in: [ 61 ] } } }": ":$query<:fieldname<:$in>>",
    '{ _id: "k9" }': ":_id",
    "{ a: { $exists: true } }": ":fieldname<:$exists>",
    "{ $or: [ { _id: 4 }, { gate: 2 } ] }": ":$or[:_id:fieldname]",
    "{ $or: [ { kg: { $gt: 5 } }, { t: { $gt: new Date(9) } }, { u: { $gt: new Date(8) } } ] }":
        ":$or[:fieldname<:$gt>:fieldname<:$gt>:fieldname<:$gt>]",
    '{ door: "shut", until: { $lt: new Date(12) } }': ":fieldname:fieldname<:$lt>",
    '{ b: "x", c: "y", d: "z" }': ":fieldname:fieldname:fieldname",
    "{ $query: { aisle: ObjectId('7'), full: true }, $orderby: { row: 1 } }":
        ":$orderby<:fieldname>:$query<:fieldname:fieldname>",
    "{ a: [ 1, 2 ], b: [ { c: 1 }, 5, [ 1 ] ] }": ":fieldname[##]:fieldname[:fieldname##]",
    "{ a: { query: { b: 1 } } }": ":fieldname<:fieldname<:fieldname>>",
    "{ a: {}, b: [] }": ":fieldname<>:fieldname[]",
    "{ z: { $lte: 1 }, Z: 1 }": ":fieldname:fieldname<:$lte>",
    "{ a: 1, a: { b: 1 } }": ":fieldname<:fieldname>",
}


def test_shapes(spark):
    rows = spark.createDataFrame(list(SHAPES.items()), "text STRING, want STRING").select(
        "text", "want", shape_of(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in rows] == [(r.text, r.want) for r in rows]


def test_deep_documents(spark, lines):
    depth = 150
    text = "{ a: " * depth + "1" + " }" * depth
    line = f"2014-06-05T14:25:14.100-0700 [c] query a.b query: {text} planSummary: EOF 0ms"
    (row,) = read(lines, line)
    assert row.parse_status == "ok" and row.q_norm == ":fieldname<" * (depth - 1) + ":fieldname" + ">" * (depth - 1) + "&EOF"


def test_long_value_lists(lines):
    values = ", ".join(f'"v {i}"' for i in range(20_000))
    line = f"2014-06-05T14:25:14.100-0700 [c] query a.b query: {{ a: {{ $in: [ {values} ] }} }} planSummary: EOF 0ms"
    (row,) = read(lines, line)
    assert row.q_norm == ":fieldname<:$in>&EOF" and len(json.loads(row.q_json)["a"]["OP_in"]) == 20_000


def test_blank_shape_helper():
    assert canonical_shape("#") == "#" and canonical_shape("{ }") == ""


def test_workload_tables(lines):
    events = dblog.parse_dblog(lines([ALERTS, ALERTS, JOBS, HOURS, USERS, ACCEPTED, COMMAND, REPLACED]))
    as_dict = lambda df, key="n": {tuple(r)[0]: r[key] for r in df.collect()}
    assert as_dict(workload.op_counts(events)) == {"query": 4, "update": 2, "command": 1, None: 1}
    assert as_dict(workload.ns_counts(events))["depot.stock.low"] == 2
    assert None not in as_dict(workload.ns_counts(events))
    assert as_dict(workload.db_counts(events))["library"] == 2
    assert as_dict(workload.cmd_counts(events)) == {"isMaster": 1, None: 6}
    assert as_dict(workload.plan_mix(events)) == {"IXSCAN": 3, "none": 1}
    assert as_dict(workload.ns_load_map(events), "load")["library.readers"] == {"query": 1, "updateupdate": 1}
    shapes = {r["shape"]: r for r in workload.query_shapes(events).collect()}
    alerts = shapes[":$orderby<:fieldname>:$query<:fieldname:fieldname<:$lte>:fieldname>&IXSCAN"]
    assert (alerts.n, alerts.n_ns, alerts.plans, alerts.raw) == (2, 1, "IXSCAN", ALERTS)
    assert shapes["$COLLSCAN"].plans == "none"
    assert {r["shape"] for r in workload.update_shapes(events).collect()} == {":$inc<:fieldname:fieldname>", ":fieldname"}
    summary = {r.q_norm: (r.n_ns, r.n) for r in workload.canonical_summary(events).collect()}
    assert summary[None] == (2, 2) and summary[":_id"] == (2, 2)
    assert sum(r.n for r in workload.canonical_records(events).collect()) == 8


def test_series_match_joint_table(lines):
    events = dblog.parse_dblog(lines([ALERTS, JOBS, HOURS, USERS, COMMAND, REPLACED, REPLACED]))
    joint = {r.epoch: r for r in workload.ops_per_second_by_op(events).collect()}
    series = workload.ops_per_second_by_op(events, first=2, per_series=True).collect()
    for row in series:
        assert joint[row.epoch][f"{row.series}_ops"] == row.n
    assert max(sum(1 for r in series if r.series == s) for s in ("all", "update", "query")) == 2


def test_schema_fields_of_query(lines):
    events = dblog.parse_dblog(lines([ALERTS]))
    fields = {r.field: r.type for r in workload.schema_fields(events).collect()}
    assert fields == {"aisle": "ObjectId", "due": "rand-int lte", "state": "string"}
    assert {r.field for r in workload.index_keys(workload.schema_fields(events)).collect()} == set(fields)


@pytest.mark.parametrize("op", ["query", "update"])
def test_filters_do_not_repeat_the_parse(lines, op):
    events = dblog.parse_dblog(lines([ALERTS])).where(workload.is_op(op)).groupBy("ns").count()
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unix_timestamp(") == 1


ODD = {
    '{ name: /^O"Brien/ }': True,
    '{ name: /^O"Brien/, b: { c: "x } y" } }': True,
    '{ a: "one } two", b: /q"r/ }': True,
    '{ a: "{ { {", b: "\\" }", c: 1 }': True,
    "{ a: /x{2}/, b: { $in: [ { c: 1 }, { d: {} } ] } }": True,
    '{ a: "never closed }': True,
    "{ a: { b: 1 }": False,
    "a: 1 }": False,
    "{}": True,
}


def test_documents_with_odd_quotes_and_braces(lines):
    head = "2014-06-05T14:25:14.100-0700 [c] "
    queries = read(lines, *[f"{head}query a.b query: {text} planSummary: EOF 0ms" for text in ODD])
    updates = read(lines, *[f"{head}update a.b query: {{ x: /a\"b/ }} update: {text} nscanned:1 0ms" for text in ODD])
    assert [r.q_text for r in queries] == [text if found else None for text, found in ODD.items()]
    assert [r.update_text for r in updates] == [text if found else None for text, found in ODD.items()]
    assert {(r.op, r.ns, r.epoch is None) for r in queries} == {("query", "a.b", False)}


def test_deep_update_keeps_its_place_in_the_load(lines):
    deep = "{ a: " * 200 + "1" + " }" * 200
    line = f"2014-06-05T14:25:14.100-0700 [c] update a.b query: {deep} update: {{ $set: {deep} }} nscanned:1 0ms"
    (row,) = workload.ns_load(dblog.parse_dblog(lines([line]))).collect()
    assert (row.ns, row.op_read, row.n) == ("a.b", "update-$set", 1)


def test_condition_before_the_patterns(lines):
    texts = [USERS, COMMAND, HOURS]
    kept = dblog.parse_dblog(lines(texts), where=workload.in_namespace("library.readers"))
    assert [r.ns for r in kept.collect()] == ["library.readers"]


def test_event_store_prunes(spark, lines, tmp_path, capsys):
    path = str(tmp_path / "events")
    event_store.write_events(dblog.parse_dblog(lines([ALERTS, HOURS, USERS, ACCEPTED, COMMAND])), path)
    assert event_store.read_events(spark, path).count() == 4
    kept = event_store.read_events(spark, path, ns="library.readers", ops=["query"], first_day="2014-06-05", last_day="2014-06-06")
    assert [r.raw for r in kept.collect()] == [USERS]
    kept.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(ns,library.readers)" in plan and "EqualTo(op,query)" in plan


def test_shape_expression_equals_building_by_hand(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice(["#", "{}", "[]", "#,"]).rstrip(",")
        inside = [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind < 0.6:
            return "[ " + ", ".join(inside) + " ]"
        keys = [rng.choice(["_id", "a", "$in", "$or", "query", "$query", "orderby", "COLLSCAN", "EOF", "x_id", "$", "B", "é"]) for _ in inside]
        return "{ " + ", ".join(f"{k}: {v}" for k, v in zip(keys, inside)) + " }"

    texts = [value(5) for _ in range(300)] + ["", "}", "{ a: #", "] {", "{ # }", "[ a: # ]", "{ a: { b: #, } }", "# #", "{ a: 1 } }  { b: 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", shape_of_skeleton(F.col("t")).alias("s"))
    assert [(r["t"], r["s"]) for r in rows.collect()] == [(t, canonical_shape(t)) for t in texts]
    assert "Arrow" not in rows._jdf.queryExecution().toString() and "Python" not in rows._jdf.queryExecution().toString()


def test_well_formed_documents_are_not_folded(spark):
    shapes = {  # blanked document: its shape, and whether the engine's own sort gives it
        "{ b: #, a: { _id: #, $lte: # }, c: [ #, { z: # }, {} ] }": (":fieldname<:_id:$lte>:fieldname:fieldname[#:fieldname]", True),
        "{ $in: [ #, # ], $or: [ { _id: # }, { EOF: # } ], é: {} }": (":$in:$or[:_id$EOF]:fieldname<>", True),
        "{ query: { orderby: # }, a: #, $a$b: [] }": (":$ab[]:fieldname$query<:fieldname>", True),
        "{ a: " * 120 + "#" + " }" * 120: (":fieldname<" * 119 + ":fieldname" + ">" * 119, True),
        "{ b: #, a: " * 120 + "#" + " }" * 120: (":fieldname<" * 119 + ":fieldname:fieldname" + ">:fieldname" * 119, True),
        # A name that comes again, lists inside lists, names kept at the top only, and what is no document.
        "{ a: #, a: { b: # } }": (":fieldname<:fieldname>", False),
        "{ a: [ [ # ], # ] }": (":fieldname[##]", False),
        "{ query: #, a: { query: # } }": (":fieldname<:fieldname>$query", False),
        "{ b: #, a: " * 300 + "#" + " }" * 300: (":fieldname<" * 299 + ":fieldname:fieldname" + ">:fieldname" * 299, False),
        "{ a: # } { b: #, c: # }": (":fieldname:fieldname", False),
        "{ a: # } }": (":fieldname", False),
        "{ a: #}": ("#", False),
        "{ \U0001f600: #, Ａ: { } }": (":fieldname<>:fieldname", False),
    }
    rows = spark.createDataFrame([(text,) for text in shapes], "t STRING").select("t", shape_of_skeleton(F.col("t")), _by_names(F.col("t")).isNotNull())
    assert {row[0]: tuple(row[1:]) for row in rows.collect()} == shapes


def test_deep_documents_are_found_by_a_pattern(spark):
    deep = lambda n: "{ a: \"x } \\\" { y\", b: " * n + "1" + " }" * n
    for n, found in ((120, True), (predicates._DEPTH, True), (predicates._DEPTH + 1, False), (300, False)):
        text = f"{deep(n)} update: {deep(n)} nscanned:1 0ms"
        (row,) = spark.createDataFrame([(text,)], "t STRING").select(
            predicates.predicate_text(F.col("t")), predicates.update_text(F.col("t")),
            predicates._found(F.col("t"), predicates._DEEP_PREDICATE), predicates._found(F.col("t"), predicates._DEEP_UPDATE)).collect()
        assert tuple(row) == (deep(n), deep(n)) + ((deep(n), deep(n)) if found else (None, None))


def test_odd_lines_are_written_once(spark, tmp_path):
    events = [(i, i + 7, "2024-01-01 00:00:11.172") for i in range(32)] + [(None, 1, "2024-01-01 00:00:11.172"), (-3, 1, "2024-01-01 00:00:11.172"), (32, None, "2024-01-01 00:00:11.172"), (44, 5, None)]
    spark.createDataFrame(events, "event_id BIGINT, user_id BIGINT, ts STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    log = render.odd_dblog(spark, str(tmp_path))
    found = {row.pos: row.value for row in log.collect()}
    assert sorted(found) == [*range(32), 44] and found[44] == "yesterday [conn5] insert odd1.docs ninserted:1 0ms"
    assert found[17] == "2024-01-01T00:00:11.172+0000 [conn24] query odd0.docs query: { following: { $in: [ 24, 17 ] } } planSummary: IXSCAN { following: 1 } ntoreturn:10 0ms"
    assert log._jdf.queryExecution().optimizedPlan().toString().count("date_format(") == 1
