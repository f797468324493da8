"""Document fingerprints as threshold-scaled sketches of shingle hashes.

A sketch keeps every hash of a document's five-word shingles that lies below a fixed fraction of all hash values.  The
threshold is the same for all documents, so the sketch of a union is the union of the sketches, and the share of one
sketch found in another estimates containment however unequal the two documents are.  A document too short to have a
hash below the threshold keeps its smallest one, so its sketch is not empty; such a hash lies above the threshold
and drops out of unions with others, so it does not tell whether a longer document holds the short one.

Only DataFrame functions.  The next document in order of identifiers comes from windows over ranges of identifiers, not from
one sorted partition: the ranges are cut at quantiles, and the first row of each range goes to the range before
it as a guest.

Null texts count as empty; a text without words has an empty sketch.  Equal sketches have a likeness of 1, also empty
ones; an empty one has nothing in common with another.  Null identifiers come last in descending order; rows with the
same identifier follow each other by the hash of their text.  The last row is followed by the first, a single row by itself.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opslens.llm._common import let, table, words_of

SHINGLE = 5
#: One hash in 2^SHIFT is kept.
SHIFT = 2
#: Hexadecimal digits of each hash in a fingerprint's text.
DIGITS = 8
RANGE_ROWS, RANGES = 1024, 1024
LOWEST = -(1 << 63)


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """One hash for every ``size`` successive words; fewer words are one shingle."""
    several = let(F.transform(words, lambda w: F.xxhash64(w)), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - size), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(size)])))
    return F.when(F.size(words) >= size, several).when(F.size(words) > 0, F.array(F.xxhash64(F.transform(words, lambda w: F.xxhash64(w))))).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column) -> Column:
    """The sorted distinct hashes below the threshold, or the smallest hash of all."""
    below = lambda h: F.shiftrightunsigned(h, 64 - SHIFT) == 0

    def kept(hashes):
        low = F.sort_array(F.array_distinct(F.filter(hashes, below)))
        return F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(low)

    return let(let(words_of(text), shingle_hashes), kept)


def as_text(kept: Column) -> Column:
    """A sketch as text: the upper digits of every hash, in order."""
    digits = F.transform(kept, lambda h: F.lpad(F.lower(F.hex(F.shiftrightunsigned(h, 64 - SHIFT - 4 * DIGITS).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1)))), DIGITS, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity as two sketches estimate it."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).otherwise(F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Share of document a that document b holds, as their sketches estimate it; null (undecided) where that of a is only a hash above the threshold."""
    above = (F.size(a) == 1) & (F.shiftrightunsigned(F.get(a, F.lit(0)), 64 - SHIFT) != 0)
    return F.when(a == b, 1.0).when(above & (F.size(b) > 0), F.lit(None)).otherwise(F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))).cast("double")


def merged(sketches: DataFrame, group: str, kept: str = "sketch") -> DataFrame:
    """The sketches of whole groups as rows (group, hash): a union, so a group of any size is never one row."""
    hashes = sketches.select(group, F.explode(kept).alias("hash")).distinct()
    return hashes.where(F.shiftrightunsigned("hash", 64 - SHIFT) == 0)


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row after each, in descending order of ``key`` (no nulls), in a circle."""
    rows = df.select(key).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = min(RANGES, max(1, -(-rows // RANGE_ROWS)))
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    ranged = df.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0))
    # At most RANGES rows: the first key of every range that has rows.
    heads = sorted((r["__range"], r["head"]) for r in ranged.groupBy("__range").agg(F.max(key).alias("head")).collect())
    if not heads:
        return ranged.select(*df.columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    # Ranges that are empty have no rows to look anything up.
    head, before = [None] * n, [None] * n
    for i, (at, first) in enumerate(heads):
        head[at], before[at] = first, heads[(i + 1) % len(heads)][0]
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__range"))
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(pick(before, "int").alias("range"), F.lit(True).alias("guest"))
    placed = ranged.withColumn("__to", F.explode(F.when(F.col(key) == pick(head, "long"), F.array(own, guest)).otherwise(F.array(own))))
    placed = placed.withColumn("__range", F.col("__to.range")).withColumn("__guest", F.col("__to.guest"))
    order = W.partitionBy("__range").orderBy("__guest", F.desc(key), "__tie")
    placed = placed.withColumn("__tie", F.xxhash64(*columns))
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("__guest")).select(*df.columns, *[f"next_{c}" for c in columns])


def op10_document_sketch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    documents = table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"))), "key", ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


QUERIES = {"op10_document_sketch": op10_document_sketch}
SQL = {}
