"""Database server log lines as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import predicates, shapes
from opslens.functions.text import blanks

# Fixed values of the log format.
OPERATIONS = ["command", "update", "query", "insert", "remove", "getmore"]
PLAN_MARK = "planSummary:"
PLAN = "(?:^| )planSummary: ([^ ]*)"
UPDATE_OPERATORS = ["inc", "set", "pull"]

CHEAP = ["ts", "epoch", "conn", "op", "ns", "cmd"]
DOCUMENTS = ["q_text", "update_text", "q_plan", "no_document"]


def parse_dblog(lines: DataFrame, strict_reference: bool = False, where: Column | None = None) -> DataFrame:
    """One event per line, as pure column expressions.

    ``parse_status`` is ``ok``; ``skipped`` for lines that are no operation; ``error`` for
    operations whose time cannot be read, both with NULL fields; ``unreadable`` for operations
    without a readable document, where only the documents are NULL.  ``strict_reference`` also
    counts documents that hold a string with a blank as errors, as token-wise quoting does.

    ``skipped`` marks lines that are no operation, and needs no look at documents, which ``parse_status`` does.

    ``where`` is a condition on ``ts``, ``epoch``, ``conn``, ``op`` and ``ns``; it is tested
    before any pattern looks for documents.
    """
    token = lambda i: F.get(F.col("t"), F.lit(i))
    is_op = lambda *names: F.col("op0").isin(*names)
    rest = F.col("rest")
    # A plan mark among the first five words belongs to a query without a document.
    has_plan = is_op("query") & ~F.array_contains(F.slice("t", 1, 5), F.lit(PLAN_MARK))

    cut = lines.select("file", "chunk", "pos", "value", F.split(blanks(F.col("value")), " ", 6).alias("t"))
    cut = cut.withColumns({"op0": token(2), "rest": token(5)}).withColumn("word5", F.substring_index("rest", " ", 1))
    cheap = cut.select(
        "file", "chunk", "pos", "value", "t", "op0", "rest", "word5",
        token(0).alias("ts"),
        F.when(is_op(*OPERATIONS), F.unix_timestamp(token(0).try_cast("timestamp"))).alias("epoch"),
        token(1).alias("conn"),
        F.col("op0").alias("op"),
        token(3).alias("ns"),
    )
    if where is not None:
        cheap = cheap.where(where)
    # What is cheap goes through a generated row, so that later filters on it do not run its patterns once more below.
    # Documents are plain columns above that row: only a query that asks for one looks for them.
    known = F.coalesce(is_op(*OPERATIONS), F.lit(False))
    state = F.when(~known, "skipped").when(F.col("epoch").isNull(), "error").otherwise("ok")
    fields = {name: F.col(name) for name in CHEAP if name != "cmd"} | {"cmd": F.when(is_op("command"), F.col("word5"))}
    kept = [F.when(known & F.col("epoch").isNotNull(), value).alias(name) for name, value in fields.items()]
    row = cheap.select("file", "chunk", "pos", "value", F.inline(F.array(F.struct(
        *kept, state.alias("state"), F.col("rest").alias("rest"), F.col("word5").alias("word5"), has_plan.alias("has_plan")))))
    read = row.select(
        "file", "chunk", "pos", F.col("value").alias("raw"), *CHEAP, "state",
        F.when(F.col("op").isin("query", "update"), predicates.predicate_text(rest)).alias("q_text"),
        F.when(F.col("op") == "update", predicates.update_text(rest)).alias("update_text"),
        F.when(F.col("has_plan") & (F.col("state") == "ok"), F.nullif(F.regexp_extract(rest, PLAN, 1), F.lit(""))).alias("q_plan"),
        F.when((F.col("op") == "query") & F.col("word5").isin(*shapes.NO_DOCUMENT), F.col("word5")).alias("no_document"),
    )
    unreadable = (
        ((F.col("op") == "query") & F.col("q_text").isNull() & F.col("no_document").isNull())
        | ((F.col("op") == "update") & F.col("update_text").isNull())
    )
    skipped = (F.col("state") == "skipped").alias("skipped")
    status = F.when(F.col("state") != "ok", F.col("state")).when(unreadable, "unreadable").otherwise("ok")
    if not strict_reference:
        return read.select("file", "chunk", "pos", "raw", *CHEAP, *DOCUMENTS, skipped, status.alias("parse_status"))
    spaced = lambda name: F.coalesce(predicates.has_spaced_string(F.col(name)), F.lit(False))
    broken = (F.col("state") == "ok") & (spaced("q_text") | spaced("update_text"))
    strict = F.when(broken, "error").otherwise(status)
    return read.select("file", "chunk", "pos", "raw", *[F.when(~broken, F.col(name)).alias(name) for name in [*CHEAP, *DOCUMENTS]], skipped, strict.alias("parse_status"))


def parsed_or_failed(events: DataFrame) -> DataFrame:
    """Leaves out only the lines that are no operation."""
    return events.where(~F.col("skipped"))


def document_json(text: Column, no_document: Column) -> Column:
    """JSON text of a document, or of the plan word that stands in its place."""
    word = F.when(no_document.isNotNull(), F.format_string('{"%s":"%s"}', no_document, no_document))
    return F.coalesce(predicates.to_json_text(text), word)


def with_predicates(events: DataFrame) -> DataFrame:
    """Adds ``q_json``, ``q_string`` and ``update_json``."""
    return (events.withColumn("q_json", document_json(F.col("q_text"), F.col("no_document")))
            .withColumn("q_string", predicates.plain_text(F.col("q_json")))
            .withColumn("update_json", predicates.to_json_text(F.col("update_text"))))


def query_shape(op: Column, text_shape: Column, no_document: Column, plan: Column) -> Column:
    """``q_norm``: the shape, followed by ``&`` and the plan for queries that have one."""
    shape = F.coalesce(text_shape, F.concat(F.lit("$"), no_document))
    suffix = F.when((op == "query") & plan.isNotNull(), F.concat(F.lit("&"), plan)).otherwise("")
    return F.concat(shape, suffix)


def with_shapes(events: DataFrame) -> DataFrame:
    """Adds ``q_norm`` and ``update_norm`` to every row."""
    shaped = (events.withColumn("q_shape", shapes.shape_of(F.col("q_text")))
              .withColumn("update_norm", shapes.shape_of(F.col("update_text"))))
    return shaped.withColumn("q_norm", query_shape(
        F.col("op"), F.col("q_shape"), F.col("no_document"), F.col("q_plan"))).drop("q_shape")


def op_read() -> Column:
    """Operation decoded one level further: command name, kind of update, or the operation."""
    keys = F.json_object_keys(predicates.to_json_text(F.col("update_text")))
    wanted = F.array(*[F.lit(f"OP_{name}") for name in UPDATE_OPERATORS])
    found = F.get(F.array_intersect(wanted, keys), F.lit(0))
    update = F.concat(F.lit("update"), F.coalesce(F.replace(found, F.lit("OP_"), F.lit("-$")), F.lit("update")))
    return (F.when(F.col("op") == "command", F.col("cmd"))
            .when(F.col("op") == "update", update).otherwise(F.col("op")))


def db_name(ns: Column) -> Column:
    return F.substring_index(ns, ".", 1)
