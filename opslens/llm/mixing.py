"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: every source gets its weight's share of all tokens; no target is above ``PASSES`` times its source, the
   excess goes to the others by weight (the level at which the targets fill up exactly, in closed form).
2. Blocks of ``BLOCK`` tokens are allocated to sources by highest quotients, then each source's to its shards.  Only the
   few seats near the last quotient are listed and ranked; all others are certain from the targets.
3. A shard is a part of a source by a hash of the document.  Its documents, ordered by that hash, form a row of blocks.
   A quota takes the whole row as often as it fits, and the rest as blocks at even distances from a seeded start.
4. What a source's blocks miss of its target in tokens is settled in its largest shard, whose last chosen block ends where
   the target is met; so small sources get their target as well, which may be less than a block.

Every choice depends on data and seed alone, so reruns agree.  A source has a shard for every ``SHARD_TOKENS`` tokens, and
``SHARDS`` at most, so a hot source is spread, and so is an identifier whose rows differ in size; shards are sorted by Spark,
never collected.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order; null identifiers are
ordered like the text "null".  Repeated rows count as often as they come.  An empty table gives an empty
result.  Columns of the input are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opslens.llm._common import saved, table

BLOCK = 32
PASSES = 3
SHARD_TOKENS = 1 << 17
SHARDS = 1 << 16
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def code(*parts: Column | str) -> Column:
    """A number below 2^32 from the digest of the parts and the seed."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts], F.lit(str(SEED)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def cyclic_weight(position: Column) -> Column:
    """1, 2, 3, repeating over the sources in order."""
    return ((position - 1) % 3 + 1).cast("double")


def targets(sizes: DataFrame, weight=cyclic_weight) -> DataFrame:
    """(key, source, source_size, position, target) for the rows (key, source, source_size) of ``sizes``, one per source.

    Filled in order of size over weight, the sources stop at their caps until the level that is left is below
    the next cap; all further ones get their weight times that level.
    """
    ordered = sizes.withColumn("position", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ordered = ordered.withColumn("weight", weight(F.col("position"))).withColumn("cap", (PASSES * F.col("source_size")).cast("double"))
    ordered = ordered.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "position").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    ordered = ordered.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ordered = ordered.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "position", "level"))).over(whole)["level"])
    return ordered.select("key", "source", "source_size", "position", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))


def apportion(claims: DataFrame, group: list[str], claim: str, seats: str, order: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group go to its ``claim``s by the highest quotients claim / (2k + 1).

    Rounding with n claims moves the last quotient by less than n seats, so seats up to
    claim * (seats - n) / total are certain, those beyond claim * (seats + n) / total + 1 impossible.
    """
    all_of = W.partitionBy(*group)
    total, n = F.sum(claim).over(all_of), F.count(F.lit(1)).over(all_of)
    near = claims.withColumn("total", total.cast("double")).withColumn("n", n)
    share = F.when(F.col("total") > 0, F.col(claim) / F.col("total")).otherwise(0.0)
    near = near.withColumn("sure", F.floor(share * F.greatest(F.col(seats) - F.col("n"), F.lit(0))).cast("long"))
    near = near.withColumn("most", F.when(F.col(claim) > 0, F.floor(share * (F.col(seats) + F.col("n"))).cast("long") + 1).otherwise(F.lit(0).cast("long")))
    near = near.withColumn("open", F.col(seats) - F.sum("sure").over(all_of))
    listed = near.where(F.col("most") > F.col("sure")).select("*", F.explode(F.sequence("sure", F.col("most") - 1)).alias("k"))
    ranked = listed.withColumn("rank", F.row_number().over(all_of.orderBy(F.desc(F.col(claim) / (2 * F.col("k") + 1)), order)))
    keys = [*group, order]
    won = ranked.where(F.col("rank") <= F.col("open")).groupBy(*keys).agg(F.count(F.lit(1)).alias("won"))
    return near.join(won, keys, "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("total", "n", "sure", "most", "open", "won")


def taken_within(start: Column, size: Column, blocks: Column, rest: Column, first: Column, cut: Column | None = None) -> Column:
    """Tokens of [start, start + size) inside the chosen blocks, and before ``cut`` if there is one.

    Of ``blocks``, ``rest`` are chosen at even distances: block b where (b * rest + first) // blocks steps up.
    """
    if cut is not None:
        size = F.greatest(F.least(size, cut - start), F.lit(0))
    upto = lambda b: F.floor((b * rest + first) / blocks)
    chosen = lambda b: upto(b + 1) - upto(b)
    end = start + size
    low, high = F.floor(start / BLOCK), F.floor((end - 1) / BLOCK)
    apart = chosen(low) * ((low + 1) * BLOCK - start) + chosen(high) * (end - high * BLOCK) + (upto(high) - upto(low + 1)) * BLOCK
    return F.when((size <= 0) | (rest <= 0), 0).when(low == high, chosen(low) * size).otherwise(apart).cast("long")


def settled(shards: DataFrame) -> DataFrame:
    """(key, shard, blocks, passes, rest, first, cut): what each shard's row gives, from its ``quota`` of blocks.

    The tokens that a source's blocks miss of its target, or have too many, go to its largest shard.
    """
    of_source = W.partitionBy("key")
    limit = PASSES * F.col("shard_size")
    tokens = shards.withColumn("tokens", F.least(BLOCK * F.col("quota"), limit))
    largest = F.row_number().over(of_source.orderBy(F.desc("shard_size"), "shard")) == 1
    missing = F.round("target").cast("long") - F.sum("tokens").over(of_source)
    tokens = tokens.withColumn("tokens", F.when(largest, F.greatest(F.least(F.col("tokens") + missing, limit), F.lit(0))).otherwise(F.col("tokens")))
    whole = lambda a, b: F.floor(a / b).cast("long")
    tokens = tokens.select("key", "shard", whole(F.col("shard_size"), F.lit(BLOCK)).alias("full"), whole(F.col("tokens"), F.col("shard_size")).alias("passes"), (F.col("tokens") % F.col("shard_size")).alias("left"))
    tokens = tokens.withColumns({"some": whole(F.col("left"), F.lit(BLOCK)), "over": F.col("left") % BLOCK})
    # All full blocks and a part of the tokens behind them, or some of the full blocks, the last of them in part.
    every = F.col("some") == F.col("full")
    tokens = tokens.withColumn("blocks", F.col("full") + every.cast("long"))
    tokens = tokens.withColumn("rest", F.when(F.col("left") == 0, 0).when(every, F.col("blocks")).otherwise(F.col("some") + (F.col("over") > 0).cast("long")).cast("long"))
    tokens = tokens.withColumn("first", code("first", F.col("key"), F.col("shard")) % F.col("blocks"))
    last = whole(F.col("rest") * F.col("blocks") - F.col("first") + F.col("rest") - 1, F.greatest("rest", F.lit(1))) - 1
    cut = F.when(every, F.col("left")).when(F.col("over") == 0, BLOCK * F.col("full")).otherwise(BLOCK * last + F.col("over"))
    return tokens.select("key", "shard", "blocks", "passes", "rest", "first", cut.cast("long").alias("cut"))


def mix(df: DataFrame, doc_id: str, source: str, size: Column) -> DataFrame:
    """``row`` (all columns of ``df``) with size, source_size, target, passes, start, blocks, rest, first, cut and taken.

    ``passes`` whole copies are taken, and the tokens of the chosen blocks once more.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(sizes).withColumn("seats", F.floor((F.sum("source_size").over(W.partitionBy()) + BLOCK // 2) / BLOCK).cast("long"))
    goal = apportion(goal.withColumn("all", F.lit(1)), ["all"], "target", "seats", "position")
    goal = goal.withColumn("shards", F.least(F.lit(SHARDS), F.floor(F.col("source_size") / SHARD_TOKENS) + 1).cast("long"))
    goal = saved(goal.select("key", "source_size", "target", F.col("quota").alias("source_quota"), "shards"), "mix-sources")
    rows = rows.join(goal, "key").withColumn("shard", F.when(F.col("size") > 0, code("shard", F.col("doc"), F.col("size")) % F.col("shards")).otherwise(F.lit(-1)))

    held = rows.where("size > 0").groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("target").alias("target"))
    quotas = settled(apportion(held, ["key"], "shard_size", "source_quota", "shard"))
    # Empty documents take no part in the order of their shard.
    ahead = W.partitionBy("key", "shard").orderBy("at", "doc", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.where("size > 0").withColumn("at", code("order", F.col("doc"))).withColumn("start", F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("long")))
    placed = placed.join(quotas, ["key", "shard"])
    taken = F.col("passes") * F.col("size") + taken_within(F.col("start"), F.col("size"), F.col("blocks"), F.col("rest"), F.col("first"), F.col("cut"))
    out = ["row", "size", "source_size", "target", "passes", "start", "blocks", "rest", "first", "cut", "taken"]
    none = [F.lit(0).cast("long").alias(c) for c in out[4:]]
    return placed.withColumn("taken", taken.cast("long")).select(*out).unionAll(rows.where("size = 0").select(*out[:4], *none))


def chosen_text(text: str | None, start: int, size: int, blocks: int, rest: int, first: int, cut: int | None = None) -> str | None:
    """The words of a document that lie in chosen blocks, as they stand in the text; apart ones on lines of their own."""
    if text is None:
        return None
    ranges: list[list[int]] = []
    for b in range(start // BLOCK, (start + size - 1) // BLOCK + 1):
        if ((b + 1) * rest + first) // blocks > (b * rest + first) // blocks:
            low, high = max(b * BLOCK, start) - start, min((b + 1) * BLOCK, start + size, start + size if cut is None else cut) - start
            if low >= high:
                continue
            if ranges and ranges[-1][1] == low:
                ranges[-1][1] = high
            else:
                ranges.append([low, high])
    words = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[words[low][0]:words[high - 1][1]] for low, high in ranges)


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that a mix of ``df`` consists of, with the columns of ``df``.

    A document comes whole as often as its shard's row is taken whole, and once more with the text of its chosen blocks.
    """
    @F.pandas_udf("string")
    def cut(texts: pd.Series, start: pd.Series, size: pd.Series, blocks: pd.Series, rest: pd.Series, first: pd.Series, until: pd.Series) -> pd.Series:
        return pd.Series([chosen_text(*row) for row in zip(texts, start, size, blocks, rest, first, until)], dtype=object)

    mixed = mix(df, doc_id, source, size_of(F.col(f"`{text}`"))).withColumnRenamed("cut", "until")
    part = F.col("taken") > F.col("passes") * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("passes").cast("int")), F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = mixed.withColumn("part", F.explode(copies))
    rows = rows.withColumn("cut", cut(F.when(F.col("part"), F.col(f"row.`{text}`")), "start", "size", "blocks", "rest", "first", F.col("until")))
    new = {text: F.col("cut"), n_chars: F.length("cut").cast("long")}
    return rows.select(*[F.when(F.col("part"), new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in df.columns])


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    """Tokens that the mix takes of every document."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    mixed = mix(saved(sized, "mix-sizes"), "doc_id", "source", F.col("size"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def _apportion_sql(claims: str, group: str, claim: str, seats: str, order: str, name: str) -> str:
    return f"""
{name}_near AS (SELECT *, sum({claim}) OVER (PARTITION BY {group})::DOUBLE AS total, count(*) OVER (PARTITION BY {group}) AS n FROM {claims}),
{name}_sure AS (SELECT *, floor(share * greatest({seats} - n, 0))::BIGINT AS sure, CASE WHEN {claim} > 0 THEN floor(share * ({seats} + n))::BIGINT + 1 ELSE 0 END AS most
  FROM (SELECT *, CASE WHEN total > 0 THEN {claim} / total ELSE 0 END AS share FROM {name}_near)),
{name}_open AS (SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS open FROM {name}_sure),
{name}_listed AS (SELECT *, unnest(range(sure, most)) AS k FROM {name}_open),
{name}_won AS (SELECT {group}, {order}, count(*) AS won FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {claim}::DOUBLE / (2 * k + 1) DESC, {order}) AS rank FROM {name}_listed) WHERE rank <= open GROUP BY ALL),
{name} AS (SELECT o.*, sure + coalesce(won, 0) AS quota FROM {name}_open o LEFT JOIN {name}_won USING ({group}, {order}))"""


def _code_sql(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + f", '{SEED}')), 1, 8))::BIGINT"


SQL_TEXT = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce('s' || source, 'n') AS key FROM documents),
sizes AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (SELECT *, ((position - 1) % 3 + 1)::DOUBLE AS weight, ({PASSES} * source_size)::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM sizes)),
levels AS (SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level, cap / weight AS ratio
  FROM weighed WINDOW before AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT key, source_size, position, coalesce(least(cap, weight * (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, position LIMIT 1)), cap) AS target,
  (sum(source_size) OVER () + {BLOCK // 2})::BIGINT // {BLOCK} AS seats, 1 AS everything FROM levels),
{_apportion_sql("goals", "everything", "target", "seats", "position", "goal")},
joined AS (SELECT s.doc_id, s.size, g.key, source_size, target, g.quota AS source_quota,
  CASE WHEN size > 0 THEN {_code_sql("'shard'", "coalesce(doc_id::VARCHAR, 'null')", "size::VARCHAR")} % least({SHARDS}, source_size // {SHARD_TOKENS} + 1) ELSE -1 END AS shard
  FROM sized s JOIN goal g USING (key)),
held AS (SELECT key, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota, any_value(target) AS target FROM joined WHERE size > 0 GROUP BY ALL),
{_apportion_sql("held", "key", "shard_size", "source_quota", "shard", "quoted")},
tokened AS (SELECT *, least({BLOCK} * quota, {PASSES} * shard_size) AS plain FROM quoted),
worded AS (SELECT key, shard, shard_size // {BLOCK} AS full_blocks, tokens // shard_size AS passes, tokens % shard_size AS left_over FROM (
  SELECT *, (CASE WHEN row_number() OVER (PARTITION BY key ORDER BY shard_size DESC, shard) = 1
    THEN greatest(least(plain + round(target)::BIGINT - sum(plain) OVER (PARTITION BY key), {PASSES} * shard_size), 0) ELSE plain END)::BIGINT AS tokens FROM tokened)),
stepped AS (SELECT *, left_over // {BLOCK} = full_blocks AS every, full_blocks + (left_over // {BLOCK} = full_blocks)::BIGINT AS blocks,
  CASE WHEN left_over = 0 THEN 0 WHEN left_over // {BLOCK} = full_blocks THEN full_blocks + 1 ELSE left_over // {BLOCK} + (left_over % {BLOCK} > 0)::BIGINT END AS rest FROM worded),
quotas AS (SELECT key, shard, blocks, passes, rest, first,
  CASE WHEN every THEN left_over WHEN left_over % {BLOCK} = 0 THEN {BLOCK} * full_blocks ELSE {BLOCK} * ((rest * blocks - first + rest - 1) // greatest(rest, 1) - 1) + left_over % {BLOCK} END AS cut
  FROM (SELECT *, {_code_sql("'first'", "key", "shard::VARCHAR")} % blocks AS first FROM stepped)),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY {_code_sql("'order'", "coalesce(doc_id::VARCHAR, 'null')")}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM joined JOIN quotas USING (key, shard) WHERE size > 0),
bounds AS (SELECT *, start // {BLOCK} AS low, (start + part - 1) // {BLOCK} AS high FROM (SELECT *, greatest(least(size, cut - start), 0) AS part FROM placed)),
steps AS (SELECT *, (low * rest + first) // blocks AS at_low, ((low + 1) * rest + first) // blocks AS after_low, (high * rest + first) // blocks AS at_high, ((high + 1) * rest + first) // blocks AS after_high FROM bounds)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN part <= 0 OR rest <= 0 THEN 0 WHEN low = high THEN (after_low - at_low) * part
  ELSE (after_low - at_low) * ((low + 1) * {BLOCK} - start) + (after_high - at_high) * (start + part - high * {BLOCK}) + (at_high - after_low) * {BLOCK} END)::BIGINT AS taken FROM steps
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM joined WHERE size = 0
"""

QUERIES = {"op3_source_mix": op3_source_mix}
SQL = {"op3_source_mix": SQL_TEXT}
