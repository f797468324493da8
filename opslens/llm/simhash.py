"""Near duplicates by SimHash fingerprints, found with Golay-code keys.

* A fingerprint has a bit for each bit of the shingles' hashes, 1 where over half of them have it.
* Equal fingerprints become one class first, so copies cost one row from there on.
* ``Scheme`` cuts a fingerprint into segments.  By the pigeonhole principle links of few differing bits leave
  some segment with no error, and some with two at most; the Golay code gives such a segment a shared index.
  A key is the exact value of some segments with the index of others, several keys for each fingerprint.
* Rows of one key meet in one task, sorted; they are compared there in blocks of ``BLOCK`` rows and only a
  spanning forest of the verified links leaves the task.  A key with more rows is cut into blocks, and every two
  of its blocks meet in a group of their own, so nothing is left out and no task holds more than two blocks.
* Components of the links are found by star steps over written tables.

Null texts count as empty; empty texts have the fingerprint zero, linked like any other.  Repeated rows, ties
and null identifiers are kept: a class without any identifier has a null component.  Only the named
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm import golay
from opslens.llm._common import connected_components, saved, table

BLOCK = 4096
CHUNK = 1 << 16
SEED = 42
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Scheme:
    """``segments``: first bit and length (23 bits at most) of each; ``keys``: exact segments and fuzzy segments of each key.

    Links differ in ``radius`` bits at most.
    """
    words: int
    bits: int
    radius: int
    segments: tuple[tuple[int, int], ...]
    keys: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]


#: 64 bits, three errors, complete: of four segments of 16 bits take one without error; the next segment has two
#: errors at most for at least one such choice, whichever way three errors fall on the four.
EXACT64 = Scheme(3, 64, 3, tuple((16 * i, 16) for i in range(4)), tuple(((i,), ((i + 1) % 4,)) for i in range(4)))


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of the text in lower case (A-Z), space-joined; of fewer words the whole sequence, of none nothing."""
    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    whole = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    return [whole[a:b - 1] for a, b in zip([0, *ends], ends[words - 1:])]


def fingerprint(text: str | None, scheme: Scheme) -> tuple[bytes, int]:
    """The fingerprint, highest bit of the first hash first, and the number of shingles counted."""
    parts = shingles(text, scheme.words)
    ones = np.zeros(scheme.bits, np.int64)
    for i in range(0, len(parts), CHUNK):
        some = parts[i:i + CHUNK]
        raw = b"".join([xxhash.xxh64_digest(p, SEED) for p in some])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), -1), axis=1)
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j:j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(parts)).tobytes(), len(parts)


def fingerprints(df: DataFrame, scheme: Scheme, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp, n): identifier, hash of all columns, fingerprint and shingle count of every row."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [fingerprint(t, scheme) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "row": batch["row"], "fp": [m[0] for m in made], "n": [m[1] for m in made]})

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_hash(df).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "id long, row long, fp binary, n long")


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def segment_values(fps: np.ndarray, first: int, length: int) -> np.ndarray:
    """The bits of one segment of every fingerprint (rows of bytes) as numbers."""
    low, high = first // 8, (first + length + 7) // 8
    value = np.zeros(len(fps), np.int64)
    for i in range(low, high):
        value = value << 8 | fps[:, i]
    return value >> (8 * high - first - length) & (1 << length) - 1


def key_rows(fps: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of all fingerprints, each key once per row."""
    values = [segment_values(fps, *s) for s in scheme.segments]
    fuzzy = {i: golay.indices(values[i]) for _, more in scheme.keys for i in more}
    at, keys = [], []
    for k, (exact, more) in enumerate(scheme.keys):
        base = np.full((len(fps), 1), k, np.int64)
        for i in exact:
            base = base << scheme.segments[i][1] | values[i][:, None]
        for i in more:
            first, further = fuzzy[i]
            choices = np.concatenate([first[:, None], further], axis=1)
            base = (base[:, :, None] << 12 | choices[:, None, :]).reshape(len(fps), -1)
        base.sort(axis=1)
        fresh = np.ones(base.shape, bool)
        fresh[:, 1:] = base[:, 1:] != base[:, :-1]
        at.append(np.nonzero(fresh)[0])
        keys.append(base[fresh])
    return np.concatenate(at), np.concatenate(keys)


def as_matrix(fps, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint8).reshape(-1, width)


def roots_of(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i] in ``parent``, where every row points at its root."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further


class Forest:
    """Links among some rows, kept as the classes that they join."""

    def __init__(self, fps: np.ndarray, scheme: Scheme):
        self.fps, self.scheme = fps, scheme
        self.parent = np.arange(len(fps))

    def look(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares the rows a[i] and b[i] that are of different classes."""
        apart = self.parent[a] != self.parent[b]
        a, b = a[apart], b[apart]
        near = np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(axis=1, dtype=np.int64) <= self.scheme.radius
        if near.any():
            self.parent = roots_of(self.parent, a[near], b[near])

    def links(self, node: np.ndarray) -> pd.DataFrame:
        """(a, b, block): links with block -1."""
        moved = self.parent != np.arange(len(self.parent))
        return pd.DataFrame({"a": node[moved], "b": node[self.parent[moved]], "block": np.full(moved.sum(), -1)})


def linked_runs(key: np.ndarray, fps: np.ndarray, scheme: Scheme) -> Forest:
    """The links of rows of the same key; rows come sorted by key."""
    forest = Forest(fps, scheme)
    first = np.arange(len(key) - 1)
    lag = 1
    while len(first):
        first = first[first + lag < len(key)]
        first = first[key[first] == key[first + lag]]
        forest.look(first, first + lag)
        lag += 1
    return forest


OUT = "a long, b long, block long, key long, n long, fp binary"


def compare_sorted(scheme: Scheme, block_rows: int):
    """For sorted rows (key, node, n, fp): links (a, b) with a negative block, and all rows of overlong keys as (a, block, key, n, fp)."""
    width = scheme.bits // 8

    def links(rows: pd.DataFrame):
        fps = as_matrix(rows["fp"], width).view(np.uint64)
        found = linked_runs(rows["key"].to_numpy(), fps, scheme).links(rows["node"].to_numpy())
        return found.assign(key=0, n=0, fp=None)

    def overlong(rows: pd.DataFrame, block: int):
        return pd.DataFrame({"a": rows["node"], "b": rows["node"], "block": block, "key": rows["key"], "n": rows["n"], "fp": rows["fp"]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, block = None, 0  # the rows of the last key so far, and how many blocks of it went out already
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows["key"].iloc[-1]
            done = rows["key"].searchsorted(last)
            if done and block:  # the overlong key ended
                end = rows["key"].searchsorted(rows["key"].iloc[0], side="right")
                yield links(rows[:end])
                yield overlong(rows[:end], block)
                rows, done, block = rows[end:].reset_index(drop=True), done - end, 0
            if done:
                yield links(rows[:done])
            rest = rows[done:].reset_index(drop=True)
            while len(rest) > block_rows:
                yield links(rest[:block_rows])
                yield overlong(rest[:block_rows], block)
                rest, block = rest[block_rows:].reset_index(drop=True), block + 1
        if rest is not None and len(rest):
            yield links(rest)
            if block:
                yield overlong(rest, block)

    return work


def compare_blocks(scheme: Scheme):
    """Links between the rows of two blocks of one key."""
    width = scheme.bits // 8

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable", ignore_index=True)
        fps, node = as_matrix(rows["fp"], width).view(np.uint64), rows["node"].to_numpy()
        block = rows["block"].to_numpy()
        cut = int(np.searchsorted(block, block[0], side="right"))
        forest, right = Forest(fps, scheme), np.arange(cut, len(rows))
        for i in range(cut):
            forest.look(np.full(len(right), i), right)
        return forest.links(node)

    return work


def links(classes: DataFrame, scheme: Scheme, block_rows: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b, block) of the links between the rows (node, fp, n) of ``classes``; block is -1."""
    width = scheme.bits // 8

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, keys = key_rows(as_matrix(batch["fp"], width), scheme)
                yield pd.DataFrame({"key": keys, "node": batch["node"].to_numpy()[at], "n": batch["n"].to_numpy()[at], "fp": batch["fp"].to_numpy()[at]})

    rows = classes.select("node", "fp", "n").mapInPandas(keyed, "key long, node long, n long, fp binary")
    rows = rows.repartition("key").sortWithinPartitions("key", "n")
    found = saved(rows.mapInPandas(compare_sorted(scheme, block_rows), OUT), "links")
    within = found.where("block < 0").select("a", "b", "block")
    # Keys of more than one block: every two blocks meet.
    over = found.where("block >= 0")
    count = over.groupBy("key").agg(F.max("block").alias("last"))
    pairs = over.join(count, "key").select("key", F.col("a").alias("node"), "n", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    pairs = pairs.where("block <> other").select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    between = pairs.groupBy("key", "low", "high").applyInPandas(compare_blocks(scheme), "a long, b long, block long")
    return within.unionAll(between)


def components(df: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK) -> DataFrame:
    """(id, row, fp, n, root, component) for every row of ``df``: component is the smallest identifier reachable over links."""
    rows = saved(fingerprints(df, scheme, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.max("n").alias("n"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = connected_components(links(classes, scheme, block_rows))
    # Classes without links are components of their own.
    whole = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("least").alias("component"))
    named = whole.join(least, "root").select("fp", "root", "component")
    return rows.join(named, "fp").select("id", "row", "fp", "n", "root", "component")


def one_of_each(df: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the smallest identifier stays, a null one last.

    Rows are told apart by identifier and a hash of all columns; rows that agree in both are copies, and one stays.
    """
    found = components(df, scheme, id_col, text_col, block_rows)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best"))
    stays = best.select(F.coalesce("best.id", F.lit(LOWEST)).alias("id"), F.col("best.row").alias("hash"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("id"), row_hash(df).alias("hash"))
    one = rows.join(stays, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at three differing bits of 64 or fewer."""
    found = components(table(spark, sf_dir, "documents"), EXACT64)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
SQL = {}
