"""Workload questions over database log events: rates, mixes, load, shapes, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions import predicates, shapes
from opslens.sources import dblog
from opslens.sources.dblog import parsed_or_failed

# The series of the rate chart.
SERIES = ["update", "command", "query", "insert", "getmore"]


def is_op(name: str) -> Column:
    return F.col("op") == name


def in_namespace(ns: str) -> Column:
    return F.col("ns") == ns


def counts(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows per key; the NULL key is a group of its own."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def ops_per_second(events: DataFrame, where: Column | None = None) -> DataFrame:
    kept = events if where is None else events.where(where)
    return counts(kept, "epoch")


def ops_per_second_by_op(events: DataFrame, first: int | None = None, per_series: bool = False) -> DataFrame:
    """All series in one pass.

    The joint table has one row per second.  ``per_series`` gives the first seconds in
    which each operation occurs, one row per series and second.
    """
    columns = [F.count("*").alias("all_ops")] + [F.count_if(is_op(s)).alias(f"{s}_ops") for s in SERIES]
    table = events.groupBy("epoch").agg(*columns)
    if not per_series:
        return table if first is None else table.orderBy("epoch").limit(first)
    series = ["all"] + SERIES
    if first is None:
        pairs = F.array(*[F.struct(F.lit(s).alias("series"), F.col(f"{s}_ops").alias("n")) for s in series])
        return table.select("epoch", F.inline(pairs)).where("n > 0")
    pairs = F.array(*[F.struct(F.lit(s).alias("series"), F.col("all_ops" if s == "all" else f"{s}_ops").alias("n")) for s in series])
    rows = table.select("epoch", F.inline(pairs)).where("n > 0")
    if first <= int(events.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        # Every task hands on its first seconds of each series only, so no series is gathered whole.
        in_series = Window.partitionBy("series").orderBy("epoch")
        return rows.withColumn("rank", F.row_number().over(in_series)).where(F.col("rank") <= first).select("epoch", "series", "n")
    # Beyond the size that a window can be limited to: one bounded sort for each series.
    shared = rows.select(F.inline(F.array(F.struct("epoch", "series", "n"))))
    return reduce(DataFrame.unionAll, [shared.where(F.col("series") == s).orderBy("epoch").limit(first) for s in series])


def op_counts(events: DataFrame) -> DataFrame:
    return counts(events, "op")


def ns_counts(events: DataFrame) -> DataFrame:
    return counts(parsed_or_failed(events), "ns")


def db_counts(events: DataFrame) -> DataFrame:
    return counts(parsed_or_failed(events), dblog.db_name(F.col("ns")).alias("db"))


def cmd_counts(events: DataFrame) -> DataFrame:
    return counts(parsed_or_failed(events), "cmd")


def plan_mix(events: DataFrame) -> DataFrame:
    return counts(events.where(is_op("query")), F.coalesce("q_plan", F.lit("none")).alias("q_plan"))


def ns_load(events: DataFrame) -> DataFrame:
    """Operations per namespace and decoded operation, in one pass."""
    return counts(parsed_or_failed(events), "ns", dblog.op_read().alias("op_read"))


def ns_load_map(events: DataFrame) -> DataFrame:
    """The same as one map per namespace; its keys are the few decoded operations."""
    pair = F.struct(F.coalesce("op_read", F.lit("none")).alias("key"), F.col("n").alias("value"))
    return ns_load(events).groupBy("ns").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("load"))


def loaded_rows(events: DataFrame) -> DataFrame:
    return counts(events, "file", "parse_status")


def _shape_rows(events: DataFrame, text: Column, plan: Column) -> DataFrame:
    """Counts per blanked text, plan and namespace, before any Python.

    The collected set also makes Spark keep these groups in an object hash map, so the
    sample texts need no sort of the log.
    """
    order = F.struct("file", "chunk", "pos")
    events = events.where(text.isNotNull() | F.col("no_document").isNotNull())  # no shape without a document
    sample = F.struct(text.alias("q"), F.col("raw"))
    return events.groupBy(
        predicates.skeleton(text).alias("skeleton"), "no_document", plan.alias("plan"), "ns",
    ).agg(
        F.count("*").alias("n"), F.collect_set(F.coalesce(plan, F.lit("none"))).alias("plans"),
        F.min_by(sample, order).alias("sample"), F.min(order).alias("first"))


def shape_report(rows: DataFrame, shape: Column) -> DataFrame:
    """Per shape: namespaces, rows, plans, and the first document (as JSON text) and line."""
    shaped = rows.withColumn("shape", shape)
    return shaped.groupBy("shape").agg(
        F.count_distinct("ns").alias("n_ns"), F.sum("n").alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.get("plans", F.lit(0)))), ",").alias("plans"),
        F.min_by("sample", "first").alias("sample"),
        F.max("no_document").alias("no_document"),
    ).select("shape", "n_ns", "n", "plans", dblog.document_json(F.col("sample.q"), F.col("no_document")).alias("q"),
             F.col("sample.raw").alias("raw"))


def query_shapes(events: DataFrame, ns: str | None = None) -> DataFrame:
    chosen = events.where(is_op("query") if ns is None else is_op("query") & in_namespace(ns))
    rows = _shape_rows(chosen, F.col("q_text"), F.col("q_plan"))
    return shape_report(rows, dblog.query_shape(
        F.lit("query"), shapes.shape_of_skeleton(F.col("skeleton")), F.col("no_document"), F.col("plan")))


def update_shapes(events: DataFrame) -> DataFrame:
    rows = _shape_rows(events.where(is_op("update")), F.col("update_text"), F.lit(None).cast("string"))
    return shape_report(rows, shapes.shape_of_skeleton(F.col("skeleton")))


def _predicate_rows(events: DataFrame, *keys: str) -> DataFrame:
    skeleton = predicates.skeleton(F.col("q_text")).alias("skeleton")
    is_query = is_op("query").alias("is_query")
    return events.groupBy(skeleton, is_query, "no_document", "q_plan", *keys).agg(F.count("*").alias("n"))


def _canonical(rows: DataFrame) -> DataFrame:
    op = F.when(F.col("is_query"), "query")
    return rows.withColumn("q_norm", dblog.query_shape(
        F.coalesce(op, F.lit("")), shapes.shape_of_skeleton(F.col("skeleton")), F.col("no_document"), F.col("q_plan")))


def canonical_records(events: DataFrame) -> DataFrame:
    """Every distinct predicate text of every shape, with its number of rows, over all operations."""
    rows = _predicate_rows(dblog.with_predicates(events), "q_string")
    return _canonical(rows).groupBy("q_norm", "q_string").agg(F.sum("n").alias("n"))


def canonical_summary(events: DataFrame) -> DataFrame:
    """Per shape over all operations: namespaces (NULL counts as one) and rows."""
    rows = _canonical(_predicate_rows(events, "ns"))
    return rows.groupBy("q_norm").agg(
        (F.count_distinct("ns") + F.max(F.col("ns").isNull().cast("int"))).alias("n_ns"), F.sum("n").alias("n"))


def schema_fields(events: DataFrame) -> DataFrame:
    """Field types of the ``$query`` part of each query shape: ``q_norm, field, type, n``.

    Types: ``ObjectId``, ``string``, ``rand-int lte`` for a bound, otherwise the value's own text.
    """
    query = F.get_json_object("q_json", "$.OP_query")
    fields = dblog.with_predicates(events.where(is_op("query"))).select(
        predicates.skeleton(F.col("q_text")).alias("skeleton"), "no_document", "q_plan",
        F.explode(F.from_json(query, "MAP<STRING, STRING>")).alias("field", "value"))
    value = F.col("value")
    kind = (F.when(value.startswith("{") & F.get_json_object(value, "$.OP_lte").isNotNull(), "rand-int lte")
            .when(value.startswith("{") | value.startswith("["), value)
            .when(value.startswith("ObjectId"), "ObjectId").otherwise("string"))
    rows = fields.groupBy("skeleton", "no_document", "q_plan", "field", kind.alias("type")).agg(F.count("*").alias("n"))
    shape = dblog.query_shape(F.lit("query"), shapes.shape_of_skeleton(F.col("skeleton")),
                              F.col("no_document"), F.col("q_plan"))
    return rows.groupBy(shape.alias("q_norm"), "field", "type").agg(F.sum("n").alias("n"))


def index_keys(schema: DataFrame) -> DataFrame:
    """Candidate index of each shape: every field, ascending."""
    return schema.select("q_norm", "field").distinct().withColumn("direction", F.lit(1))
