"""Packing documents into sequences of a fixed length with a grouping genetic algorithm.

* Documents are tokenized in the scan; a piece is a document, or a part of one longer than a sequence.
* A chromosome is a list of bins (whole groups, not items).  Crossover injects whole well-filled bins of one parent
  into the other, drops the bins that now hold a document twice, and best-fits the documents displaced by that.
* Pieces are dealt by a hash of their row into shards of a fixed size.  Several islands evolve each shard with seeds of
  their own; after each epoch every island hands its elite to the next.  A shard ends early once it needs no more
  bins than its tokens fill.
* Bins that stay poorly filled are pooled over all shards and evolved once more, starting from what they are, so
  this never adds a sequence.

Null texts count as empty and give one piece of one token.  Repeated rows are packed as often as they come; ties are
broken by row number.  An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import saved, table

CAPACITY = 2048
SHARD_ROWS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
ELITE = 2
#: Bins below this share are pooled over the shards.
POOR = 0.97
REMEMBERED = 1 << 19


@cache
def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts, remembered by word.

    White space always separates tokens in this vocabulary, so a text's ids are those of its words.  A word of Latin
    letters with punctuation behind it is looked up by these two parts; any other word goes through the whole
    tokenizer.  ``REMEMBERED`` bounds the memory: the words are forgotten when there are more.
    """
    LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            if len(self.parts) > REMEMBERED:
                self.parts = {"": b""}
            letters = part.encode().decode("latin-1").translate(byte_letters())
            known = self.parts[part] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        return known

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        latin = self.LATIN.fullmatch(text)
        if latin:
            return self.part(latin[1].lower()) + self.part(latin[2])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        words = (text or "").encode().split()
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for word in set(words).difference(known):
                known[word] = self.word(word)
            return b"".join(map(known.__getitem__, words))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row, id 0 closing each document."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = codes.encode(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins being filled: the tightest that still takes a size is found by the lowest set bit of the free sizes."""

    def __init__(self, sizes, capacity: int):
        self.sizes, self.capacity, self.groups, self.free = sizes, capacity, [], []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def put_back(self, at: int) -> None:
        free = self.free[at]
        if free:
            self.by_free.setdefault(free, []).append(at)
            self.mask |= 1 << free

    def add(self, group: list[int]) -> None:
        self.groups.append(group)
        self.free.append(self.capacity - sum(self.sizes[i] for i in group))
        self.put_back(len(self.groups) - 1)

    def best_fit(self, items: list[int]) -> None:
        for item in items:
            size = self.sizes[item]
            room = self.mask >> size
            if not room:
                self.add([item])
                continue
            free = size + (room & -room).bit_length() - 1
            same = self.by_free[free]
            at = same.pop()
            if not same:
                self.mask &= ~(1 << free)
            self.groups[at].append(item)
            self.free[at] = free - size
            self.put_back(at)


def fitness(sizes, groups, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(groups), sum((sum(sizes[i] for i in g) / capacity) ** 2 for g in groups)


def crossover(sizes, one, two, capacity: int, rng: random.Random):
    """Child of ``one`` with whole well-filled bins of ``two``."""
    fill = sorted(two, key=lambda g: -sum(sizes[i] for i in g))
    gift = rng.sample(fill[:max(1, 3 * len(fill) // 4)], max(1, len(fill) // 4))
    taken = {i for g in gift for i in g}
    child, displaced = Bins(sizes, capacity), []
    for g in gift:
        child.add(list(g))
    for g in one:
        if taken.isdisjoint(g):
            child.add(list(g))
        else:
            displaced += [i for i in g if i not in taken]
    # Mutation: the emptiest own bins are dealt anew as well.
    open_bins = sorted(range(len(gift), len(child.groups)), key=lambda b: -child.free[b])[:1 + rng.randrange(4)]
    for b in sorted(open_bins, reverse=True):
        displaced += child.groups[b]
    kept = [g for b, g in enumerate(child.groups) if b not in set(open_bins)]
    child = Bins(sizes, capacity)
    for g in kept:
        child.add(g)
    displaced.sort(key=lambda i: (-sizes[i], i))
    child.best_fit(displaced)
    return child.groups


def evolve(sizes: list[int], start: list[list[list[int]]], capacity: int, seed: int) -> list[list[list[int]]]:
    """The elite of one island after ``GENERATIONS``, best first."""
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    population = list(start)
    while len(population) < POPULATION:
        order = falling
        if population:  # near the falling order, but of its own
            order = sorted(falling, key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
        fresh = Bins(sizes, capacity)
        fresh.best_fit(order)
        population.append(fresh.groups)
        if len(fresh.groups) <= least:
            break
    rank = lambda groups: fitness(sizes, groups, capacity)
    population.sort(key=rank, reverse=True)
    for _ in range(GENERATIONS):
        if len(population[0]) <= least:
            break
        one, two = rng.sample(population[:POPULATION], 2) if len(population) > 1 else (population[0], population[0])
        population += [crossover(sizes, one, two, capacity, rng), crossover(sizes, two, one, capacity, rng)]
        population.sort(key=rank, reverse=True)
        del population[POPULATION:]
    return population[:ELITE]


ELITES = "shard long, island int, rows array<long>, sizes array<int>, bins array<int>, n_bins int, fit double"


def as_rows(shard, island, rows, sizes, elite, capacity) -> pd.DataFrame:
    out = []
    for groups in elite:
        bins = np.zeros(len(rows), np.int32)
        for b, g in enumerate(groups):
            bins[g] = b
        out.append((shard, island, list(rows), list(sizes), bins.tolist(), len(groups), fitness(sizes, groups, capacity)[1]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ELITES.split(", ")])


def as_groups(bins) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        groups.setdefault(b, []).append(i)
    return list(groups.values())


def first_epoch(capacity: int):
    """From the items (shard, island, row, length, bin) of an island; known bins are one of its first parents."""
    def work(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("row", ignore_index=True)
        sizes = items["length"].tolist()
        start = [as_groups(items["bin"])] if items["bin"].notna().all() else []
        return as_rows(*key, items["row"].tolist(), sizes, evolve(sizes, start, capacity, hash(key) & 0xFFFF), capacity)

    return work


def next_epoch(capacity: int, epoch: int):
    """From the elites that an island has: its own and those that came from the island before it."""
    def work(key: tuple, elites: pd.DataFrame) -> pd.DataFrame:
        elites = elites.sort_values(["n_bins", "fit"], ascending=[True, False], kind="stable")
        rows, sizes = elites["rows"].iloc[0].tolist(), elites["sizes"].iloc[0].tolist()
        start = [as_groups(b.tolist()) for b in elites["bins"]]
        return as_rows(*key, rows, sizes, evolve(sizes, start, capacity, (hash(key) + 7919 * epoch) & 0xFFFFFF), capacity)

    return work


def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, shard, bin, offset, fill) of the chosen solutions."""
    for batch in batches:
        for shard, rows, sizes, bins in zip(batch["shard"], batch["rows"], batch["sizes"], batch["bins"]):
            got = pd.DataFrame({"row": rows, "shard": shard, "bin": bins.astype(np.int64), "size": sizes.astype(np.int64)}).sort_values(["bin", "row"])
            groups = got.groupby("bin")["size"]
            got["offset"] = groups.cumsum() - got["size"]
            got["fill"] = groups.transform("sum")
            yield got[["row", "shard", "bin", "offset", "fill", "size"]]


def islands(items: DataFrame, capacity: int) -> DataFrame:
    """Places (row, shard, bin, offset, fill, size) for the items (shard, row, length, bin)."""
    spread = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    elites = spread.groupBy("shard", "island").applyInPandas(first_epoch(capacity), ELITES)
    for epoch in range(1, EPOCHS):
        migrants = elites.withColumn("to", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
        migrants = migrants.withColumn("island", F.col("to")).drop("to")
        elites = migrants.groupBy("shard", "island").applyInPandas(next_epoch(capacity, epoch), ELITES)
    best = elites.groupBy("shard").agg(F.max_by(F.struct("rows", "sizes", "bins"), F.struct(-F.col("n_bins"), "fit", -F.col("island"))).alias("s"))
    return best.select("shard", "s.*").mapInPandas(place, "row long, shard long, bin long, offset long, fill long, size long")


def dealt(items: DataFrame, shard_rows: int) -> DataFrame:
    shards = max(1, -(-items.count() // shard_rows))
    return items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = saved(pieces(df, path, id_col, text_col, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    items = rows.where(F.col("length") < capacity).select("row", F.col("length").cast("int").alias("length"), F.lit(None).cast("long").alias("bin"))
    first = saved(islands(dealt(items, shard_rows), capacity), "bins")
    poor = first.where(F.col("fill") < int(POOR * capacity))
    again = poor.select("row", F.col("size").cast("int").alias("length"), (F.col("shard") * F.lit(1 << 20) + F.col("bin")).alias("bin"))
    # Whole poor bins stay together in a shard of the pool.
    shards = max(1, -(-again.count() // shard_rows))
    pool = islands(again.withColumn("shard", F.pmod(F.xxhash64("bin"), F.lit(shards))), capacity)
    number = F.col("shard") * F.lit(1 << 20) + F.col("bin")
    placed = first.where(F.col("fill") >= int(POOR * capacity)).select("row", number.alias("sequence_id"), "offset")
    placed = placed.unionAll(pool.select("row", (number + F.lit(1 << 60)).alias("sequence_id"), "offset"))
    # A full piece is a sequence of its own.
    out = rows.join(placed, "row", "left")
    out = out.withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("row"))).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def vocabulary() -> str:
    """The path of the public vocabulary that the query is bound to."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
SQL = {}
