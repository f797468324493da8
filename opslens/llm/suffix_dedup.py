"""Byte strings that a collection holds twice, found with a Burrows-Wheeler transform built column by column.

A window is any ``width`` bytes of a text.  Windows that occur at two places or more, in one text or in several, are marked;
``cut`` removes every byte that a marked window covers.

* **Dealing.**  Every window is named by the smallest hash of the shorter strings in it, so equal windows have equal
  names.  A run of neighbouring windows of one name is one string of the collection, of bounded length.  Strings whose
  name occurs once cannot hold a repeated window and leave; equal strings become one with a count.
* **Column-wise construction.**  Strings are dealt to groups by name.  A group builds the Burrows-Wheeler transform of its
  collection from the last column to the first: each round inserts one symbol of every string, at the place that the
  transform itself gives (symbols before it in the alphabet, and its rank among its own), and updates the common prefixes
  next to it by a minimum over the stretch between two equal symbols.  Stretches of strings that cannot repeat, because hashes of
  seven eighths of their windows occur once, are left out before, and equal stretches are inserted once.  A round reads the transform and the common prefixes of
  the round before once in order and writes them anew.  A suffix with a common prefix of ``width`` beside it starts a repeated window.
* **Hot names.**  A name of more than ``MOST`` different strings is cut finer: by ``STEPS`` windows around their common bytes,
  and what is still too large there by single windows, where equal strings are only counted.  No group grows with the input.
* **Recovery.**  Distinct texts are written once, bucketed by their digest, to the shared folder, and joined from there
  without another shuffle of texts; strings are cut from them where they are needed.

The sequential files of a group are byte arrays of its task: their size is bounded by ``GROUP_BYTES`` and the strings of one name,
and a task may not write to folders of its machine.

Null texts count as empty; texts shorter than a window have nothing to remove.  Very long texts are read in slices that
overlap by a window.  Equal texts get equal results, and repeated rows count as often as they come.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from opslens.llm._common import saved, table
from opslens.session import scratch_dir

WIDTH = 400
#: Bytes of the strings whose smallest hash names a window, as a share of the window.
GRAM_SHARE = 1 / 2
#: A window goes into the transform if its first and last strings of this share of its length occur again in its group.
NEARLY = 7 / 8
#: Windows of a text that are looked at together.
SLICE = 1 << 18
#: Different strings of one name that one task takes, and bytes of the strings of one group.
MOST = 1_000
GROUP_BYTES = 600_000
#: Windows of a piece of a hot name, from coarse to fine.
STEPS = (16, 1)
#: Rows of a block of the transform at first and at most; places in a block are bytes, so below 256.
BLOCK = 64
LONGEST = 192
SPAN = 16
#: Odd multiplier of the rolling hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


# ---------------------------------------------------------------- hashes of strings in a text

class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(2 * n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def string_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes of a text, by differences of prefix sums; equal strings have equal hashes."""
    up, down = POWERS(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:len(text)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[:len(text) - size + 1])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by minima from both ends of blocks of that width."""
    pad = np.full(-len(values) % width, ~np.uint64(0))
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:len(values) - width + 1], ahead[width - 1:len(values)])


def digest(part: bytes, seed: int = 0) -> int:
    code = xxh3_64_intdigest(part, seed)
    return code - (code >> 63 << 64)


def runs(names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal names, none longer than ``most``."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    ends = np.append(starts[1:], len(names))
    pieces = -(-(ends - starts) // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + nth * most
    return starts, np.minimum(starts + most, np.repeat(ends, pieces))


def strings_of(text: bytes, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(starts, windows, names, digests, places) of the strings of one text, slice by slice.

    ``places`` counts where a string holds what names it; only a string with two can hold a window twice.
    """
    reach = width - gram + 1
    for at in range(0, len(text) - width + 1, SLICE):
        part = text[at:at + SLICE + width - 1]
        grams = string_hashes(np.frombuffer(part, np.uint8), gram)
        names = smallest(grams, reach)
        starts, ends = runs(names, reach)
        places = np.ones(len(starts), np.int64)
        ranked = np.sort(grams)
        if (ranked[1:] == ranked[:-1]).any():
            places[:] = [np.count_nonzero(grams[a:b + reach - 1] == names[a]) for a, b in zip(starts.tolist(), ends.tolist())]
        codes = [xxh3_64_intdigest(part[a:b]) for a, b in zip(starts.tolist(), (ends + width - 1).tolist())]
        yield at + starts, ends - starts, names[starts].view(np.int64), np.array(codes, np.uint64).view(np.int64), places


def pieces_of(string: bytes, width: int, gram: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(offset, windows, name, digest) of the pieces of a string whose windows share a name.

    Windows are counted by their distance from the first gram that names them, and a piece is ``step`` distances; its own name
    hashes the bytes that all windows of such a piece share, so equal windows still have equal names.
    """
    grams = string_hashes(np.frombuffer(string, np.uint8), gram)
    windows = len(string) - width + 1
    least = smallest(grams, width - gram + 1)[0]
    named = np.flatnonzero(grams == least)
    anchor = named[np.searchsorted(named, np.arange(windows))]
    part = (anchor - np.arange(windows)) // step
    key = anchor.astype(np.int64) * (width + 1) + part
    for start, end in zip(*(x.tolist() for x in runs(key, step))):
        first = int(anchor[start]) - int(part[start]) * step
        shared = string[first:first - step + 1 + width]
        name = digest(b"%d:%d:" % (int(least), int(part[start])) + shared, 1)
        yield start, end - start, name, digest(string[start:end + width - 1])


# ---------------------------------------------------------------- the transform of one group

class Transform:
    """Burrows-Wheeler transform and common prefixes of a collection, one column of symbols a round.

    ``rows`` has a number for each suffix so far, in order: its low byte is the transform, the code of the symbol before
    the suffix (0: none); above it stands the common prefix with the suffix before it, up to ``most``.  Some zeros end it.

    ``bounds`` cuts the rows into blocks; ``counts`` has the symbols of each block and ``sums`` those of ``SPAN`` blocks.  All are
    brought forward with every round and made anew when a block has become too long.
    """

    def __init__(self, strings: list[bytes], most: int):
        self.most, self.n = most, len(strings)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings])
        self.ends = np.cumsum(self.sizes)
        used = np.unique(self.text)
        code = np.zeros(256, np.uint8)
        code[used] = np.arange(1, len(used) + 1)
        self.text, self.codes = code[self.text], len(used) + 1
        self.size = self.n
        self.rows = np.append(self.before(np.arange(self.n), 0), np.zeros(LONGEST, np.uint32))
        self.places = np.arange(self.n)
        self.count_anew()
        for column in range(1, self.sizes.max() + 1):
            self.insert(column)

    def before(self, which: np.ndarray, length: int) -> np.ndarray:
        """The symbol before the suffix of that length."""
        at = self.ends[which] - length - 1
        return np.where(self.sizes[which] > length, self.text[np.maximum(at, 0)], 0).astype("<u4")

    def symbols(self) -> np.ndarray:
        return self.rows[:self.size].view(np.uint8)[::4]

    def count_anew(self) -> None:
        self.bounds = np.arange(0, self.size, BLOCK)
        spans = -(-len(self.bounds) // SPAN)
        cells = self.symbols().astype(np.int64) * (spans * SPAN) + np.arange(self.size) // BLOCK
        self.counts = np.bincount(cells, minlength=self.codes * spans * SPAN).reshape(self.codes, spans, SPAN)
        self.sums = self.counts.sum(axis=2)

    def stretches(self, block: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """For each block, where from its start on the symbol stands."""
        view = np.ndarray((self.size, self.longest), np.uint8, self.rows, strides=(4, 4))
        return view[self.bounds[block]] == symbol[:, None].astype(np.uint8)

    def last_of(self, marked: np.ndarray) -> np.ndarray:
        """The last marked place of each stretch, 0 where there is none."""
        return (marked.view(np.uint8) * self.within).max(axis=1)

    def nearest(self, symbol: np.ndarray, rank: np.ndarray, last: bool) -> np.ndarray:
        """Places of the occurrences of these ranks, each the last (or the first) of its symbol in its block."""
        span = np.searchsorted(self.rising, symbol * (self.size + 1) + rank, side="right") - 1 - symbol * self.sums.shape[1]
        upto = np.cumsum(self.counts[symbol, span], axis=1)
        block = span * SPAN + (upto > (rank - self.earlier[symbol, span])[:, None]).argmax(axis=1)
        same = self.stretches(block, symbol)
        if last:
            same &= self.within < self.lengths[block][:, None].astype(np.uint8)
            return self.bounds[block] + self.last_of(same)
        return self.bounds[block] + same.argmax(axis=1)

    def lowest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One more than the smallest common prefix at the places start .. end - 1, up to ``most``, as it stands in a row."""
        if not len(start):
            return np.zeros(0, np.uint32)
        down = np.argsort(-start)  # with falling starts the stretches between two ranges are empty
        bounds = np.empty(2 * len(start), np.int64)
        bounds[::2], bounds[1::2] = start[down], end[down]
        low = np.empty(len(start), np.uint32)
        low[down] = np.minimum.reduceat(self.rows, bounds)[::2] >> 8
        return np.minimum(low + 1, self.most).astype(np.uint32) << 8

    def widened(self, slots: np.ndarray) -> np.ndarray:
        """The rows read once in order and written anew, with an empty row before each of the places."""
        old, cuts = memoryview(self.rows), slots.tolist()
        return np.frombuffer(bytearray(4).join([old[a:b] for a, b in zip([0, *cuts], [*cuts, len(old)])]), "<u4")

    def insert(self, column: int) -> None:
        """Inserts the suffixes of this length: one symbol of every string that is long enough."""
        self.lengths = np.diff(self.bounds, append=self.size)
        self.longest = int(self.lengths.max())
        if self.longest > LONGEST:
            self.count_anew()
            self.lengths, self.longest = np.diff(self.bounds, append=self.size), BLOCK
        self.within = np.arange(self.longest, dtype=np.uint8)
        upto = np.cumsum(self.sums, axis=1)
        total, self.earlier = upto[:, -1], upto - self.sums
        self.rising = (self.earlier + (np.arange(self.codes) * (self.size + 1))[:, None]).ravel()

        which = np.flatnonzero(self.sizes >= column)
        place = self.places[which]
        symbol = (self.rows[place] & 255).astype(np.int64)
        block = np.searchsorted(self.bounds, place, side="right") - 1
        inside = (place - self.bounds[block])[:, None].astype(np.uint8)
        same = self.stretches(block, symbol)
        ahead = same & (self.within < inside)
        after = same & (self.within > inside)
        span, within = block // SPAN, np.arange(SPAN) < (block % SPAN)[:, None]
        rank = self.earlier[symbol, span] + (self.counts[symbol, span] * within).sum(axis=1) + ahead.view(np.uint8).sum(axis=1, dtype=np.uint8)
        first_of = self.n + np.concatenate([[0, 0], np.cumsum(total[1:])])[:self.codes]
        new = first_of[symbol] + rank

        back = self.bounds[block] + self.last_of(ahead)
        has_back = rank > 0
        far = np.flatnonzero(~ahead.any(axis=1) & has_back)
        back[far] = self.nearest(symbol[far], rank[far] - 1, last=True)
        follow = self.bounds[block] + after.argmax(axis=1)
        has_next = rank + 1 < total[symbol]
        far = np.flatnonzero(~after.any(axis=1) & has_next)
        follow[far] = self.nearest(symbol[far], rank[far] + 1, last=False)

        order = np.argsort(new)
        slots = new[order] - np.arange(len(new))
        size, rows = self.size + len(which), self.widened(slots)
        for at, common in ((new[has_back], self.lowest(back[has_back] + 1, place[has_back] + 1)),
                           (new[has_next] + 1, self.lowest(place[has_next] + 1, follow[has_next] + 1))):
            rows[at] = common | (rows[at] & 255)
        added = self.before(which, column)
        rows[new] |= added

        # What is inserted at a bound belongs to the block that ends there.
        into = np.maximum(np.searchsorted(self.bounds, slots, side="left") - 1, 0)
        np.add.at(self.counts, (added[order], into // SPAN, into % SPAN), 1)
        np.add.at(self.sums, (added[order], into // SPAN), 1)
        self.bounds = self.bounds + np.searchsorted(into, np.arange(len(self.bounds)), side="left")
        done = np.flatnonzero(self.sizes < column)
        self.places[done] += np.searchsorted(slots, self.places[done], side="right")
        self.places[which] = new
        self.rows, self.size = rows, size

    def repeated(self, width: int) -> np.ndarray:
        """For each string (row) whether the ``width`` bytes from each start (column) occur again in the collection."""
        beside = self.rows[:self.size + 1] >> 8 >= width
        hit = beside[:-1] | beside[1:]
        order = np.argsort(self.symbols(), kind="stable")
        closed = np.count_nonzero(self.symbols() == 0)
        starts = max(int(self.sizes.max()) - width + 1, 0)
        found = np.zeros((self.n, starts), bool)
        place = self.places.copy()
        for start in range(starts):
            long = np.flatnonzero(self.sizes - start >= width)
            found[long, start] = hit[place[long]]
            place[long] = order[closed + place[long] - self.n]
        return found


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of the runs of true values in each row."""
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edges == 1)
    return row, low, np.nonzero(edges == -1)[1]


# ---------------------------------------------------------------- Spark

KEY = ["k1", "k2"]
STRING = "k1 long, k2 long, start int, windows int, name long, digest long, places int, n long"
MARKS = "name long, digest long, low int, high int"
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
#: Rows of one batch that a task hands on.
ROWS = 20_000


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def as_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def key_of(sha: Column) -> list[Column]:
    """120 bits of a SHA-256 in hex as two numbers."""
    return [F.conv(F.substring(sha, at, 15), 16, 10).cast("long").alias(name) for at, name in zip((1, 16), KEY)]


def distinct_texts(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """(k1, k2, text, n): each different text of a window or more, bucketed by its key in the shared folder."""
    spark = df.sparkSession
    rows = df.select(as_bytes(F.col(text_col)).alias("text")).where(F.octet_length("text") >= width)
    rows = rows.select(F.sha2("text", 256).alias("sha"), "text").select(*key_of(F.col("sha")), "text")
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, *KEY).option("path", scratch_dir(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def strings(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """The strings of all texts, each with the number of its text's copies."""
    schema = arrow_schema(STRING)

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(p[3]) for p in parts]
        columns = [np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (0, 1)]
        columns += [np.concatenate([p[i] for p in parts]) for i in range(3, 8)]
        columns.append(np.repeat(np.array([p[2] for p in parts], np.int64), sizes))
        return pa.record_batch([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, schema.types)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for k1, k2, text, n in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"], batch["n"].to_pylist()):
                for found in strings_of(text.as_py(), width, gram):
                    parts.append((k1, k2, n, *found))
                    rows += len(found[0])
                    if rows >= ROWS:
                        yield batch_of(parts)
                        parts, rows = [], 0
        if parts:
            yield batch_of(parts)

    return texts.select(*KEY, "text", "n").mapInArrow(work, STRING)


def with_bytes(wanted: DataFrame, texts: DataFrame, width: int, schema: str, make) -> DataFrame:
    """Rows that ``make(k1, k2, start, string, *rest)`` gives for each wanted string; texts are joined where they lie.

    ``wanted`` has ``k1, k2, start, windows`` and the columns ``rest``.
    """
    rest = [c for c in wanted.columns if c not in (*KEY, "start", "windows")]
    per_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", *rest)).alias("wanted"))
    both = texts.select(*KEY, "text").join(per_text, KEY)
    arrow = arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            counts = pc.list_value_length(batch["wanted"]).to_pylist()
            fields = [f.to_pylist() for f in batch["wanted"].flatten().flatten()]
            at = 0
            for k1, k2, text, n in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"], counts):
                whole = text.as_py()
                for start, windows, *others in zip(*(f[at:at + n] for f in fields)):
                    rows += make(k1, k2, start, whole[start:start + windows + width - 1], *others)
                    if len(rows) >= ROWS // 10:
                        yield batch_of(rows)
                        rows = []
                at += n
        if rows:
            yield batch_of(rows)

    return both.mapInArrow(work, schema)


def stretches_that_may_repeat(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, low, high): runs of window starts whose first and last ``NEARLY`` of a window both occur again in the group."""
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    size = max(1, int(width * NEARLY))
    hashes = string_hashes(np.frombuffer(b"".join(strings), np.uint8), size)
    owner = np.repeat(np.arange(len(strings)), sizes)[:len(hashes)]
    inside = np.arange(len(hashes)) - starts[owner] <= sizes[owner] - size
    again = np.zeros(len(hashes) + width, bool)
    _, which, counts = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    again[np.flatnonzero(inside)] = counts[which] > 1
    window = np.arange(len(hashes)) - starts[owner] <= sizes[owner] - width
    may = again[:len(hashes)] & again[width - size:len(hashes) + width - size] & window
    edges = np.flatnonzero(np.diff(np.concatenate([[False], may, [False]]).astype(np.int8)))
    # No window starts in the last bytes of a string, so no run goes on in the next one unless a window is one byte.
    low, high = edges[::2], edges[1::2]
    return owner[low], low - starts[owner[low]], high - starts[owner[low]]


def repeated_in(parts: list[bytes], width: int) -> np.ndarray:
    """As ``Transform.repeated``, with equal parts inserted once: their windows occur again whatever the transform says."""
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(part, len(numbers)) for part in parts])
    flags = Transform(list(numbers), width).repeated(width)
    windows = np.array([len(part) - width + 1 for part in numbers])
    flags |= (np.bincount(which) > 1)[:, None] & (np.arange(flags.shape[1]) < windows[:, None])
    return flags[which]


def grouped_marks(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """Marked windows (name, digest, low, high) of one group of strings."""
    frame = frame.drop_duplicates(["name", "digest"], ignore_index=True)
    strings = list(frame["string"])
    owner, low, high = stretches_that_may_repeat(strings, width)
    row, first, last = np.zeros((3, 0), np.int64)
    if len(owner):
        parts = [strings[o][a:b + width - 1] for o, a, b in zip(owner.tolist(), low.tolist(), high.tolist())]
        row, first, last = spans_of(repeated_in(parts, width))
        row, first, last = owner[row], low[row] + first, low[row] + last
    copied = np.flatnonzero(frame["n"].to_numpy() > 1)
    row = np.concatenate([row, copied])
    first = np.concatenate([first, np.zeros(len(copied), np.int64)])
    last = np.concatenate([last, np.array([len(strings[i]) - width + 1 for i in copied], np.int64)])
    return pd.DataFrame({"name": frame["name"].to_numpy()[row], "digest": frame["digest"].to_numpy()[row],
                         "low": first.astype("int32"), "high": last.astype("int32")})


def marks(found: DataFrame, texts: DataFrame, width: int, gram: int, most: int, steps: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The strings of ``found`` whose name occurs again, and the marked windows of each different one."""
    names = found.groupBy("name").agg(F.sum("n").alias("rows"), F.max("places").alias("places")).where("rows > 1 OR places > 1").select("name")
    names = saved(names, "repeated-names")  # a side of its own, so that Spark can split a hot name of the other
    kept = saved(found.join(names, "name", "left_semi").select(*found.columns), "strings")
    each = kept.groupBy("name", "digest").agg(F.sum("n").alias("n"), F.max("places").alias("places"), F.min(F.struct(*KEY, "start", "windows")).alias("at"))
    each = saved(each.select("name", "digest", "n", "places", "at.*"), "string-classes")
    sizes = each.groupBy("name").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.col("windows") + width - 1).alias("bytes"), F.max("places").alias("places"))
    sizes = saved(sizes.select("name", "strings", "bytes", F.expr("strings = 1 AND places = 1").alias("alone")), "names")
    alone = each.join(sizes.where("alone").select("name"), "name", "left_semi")
    whole = alone.where("n > 1").select("name", "digest", F.lit(0).alias("low"), F.col("windows").alias("high"))

    total, hot = sizes.where("NOT alone").agg(F.sum(F.when(F.col("strings") <= most, F.col("bytes"))), F.max(F.col("strings") > most)).first()
    out = whole
    if total:
        groups = int(total // GROUP_BYTES) + 1
        few = each.join(sizes.where(f"NOT alone AND strings <= {most}").select("name"), "name", "left_semi")
        whole_strings = with_bytes(few.select(*KEY, "start", "windows", "name", "digest", "n"), texts, width, "name long, digest long, n long, string binary",
                                   lambda k1, k2, start, string, name, code, n: [(name, code, n, string)])
        dealt = whole_strings.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups)))
        dealt = dealt.repartition(groups, "group")  # as many tasks as the strings ask for, whatever their bytes are in a shuffle
        out = out.unionAll(dealt.groupBy("group").applyInPandas(lambda frame: grouped_marks(frame, width), MARKS))
    if hot:
        step = steps[0]

        def cut(k1, k2, start, string, name, code, n):
            return [(k1, k2, start + at, windows, new, piece, 1, n, name, code, at) for at, windows, new, piece in pieces_of(string, width, gram, step)]

        many = each.join(sizes.where(f"strings > {most}").select("name"), "name", "left_semi")
        finer = with_bytes(many.select(*KEY, "start", "windows", "name", "digest", "n"), texts, width, STRING + ", parent long, parent_digest long, at int", cut)
        # Single windows of one name are equal, so the last step leaves nothing to sort.
        kept_pieces, found_marks = marks(saved(finer, "pieces"), texts, width, gram, most if steps[1:] else 1 << 62, steps[1:])
        placed = kept_pieces.join(found_marks, ["name", "digest"]).select(
            F.col("parent").alias("name"), F.col("parent_digest").alias("digest"), (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
        out = out.unionAll(placed)
    return kept, saved(out, "marks")


def cut_text(text: bytes, lows: np.ndarray, highs: np.ndarray, width: int) -> tuple[int, int, str, list[int], list[int]]:
    """(n_removed, n_spans, kept_sha256) and the removed spans, from the marked window starts of one text."""
    order = np.argsort(lows, kind="stable")
    lows, ends = lows[order], np.maximum.accumulate(highs[order] + width - 1)
    opens = np.concatenate([[True], lows[1:] > ends[:-1]])
    first = lows[opens]
    last = ends[np.append(opens[1:], True)]
    kept, at = hashlib.sha256(), 0
    for low, high in zip(first.tolist(), last.tolist()):
        kept.update(text[at:low])
        at = high
    kept.update(text[at:])
    return int((last - first).sum()), len(first), kept.hexdigest(), first.tolist(), last.tolist()


SPANS = "array<struct<low: long, high: long>>"
CUTS = f"k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS}"


def repeated_spans(df: DataFrame, text_col: str = "text", width: int = WIDTH, most: int = MOST, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, spans) of each different text that something is removed from."""
    texts = distinct_texts(df, text_col, width)
    gram = max(1, int(width * GRAM_SHARE))
    kept, marked = marks(saved(strings(texts, width, gram), "strings"), texts, width, gram, most, steps)
    spans = kept.join(marked, ["name", "digest"]).select(*KEY, (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    per_text = spans.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    both = texts.select(*KEY, "text").join(per_text, KEY)
    span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, marked_windows in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"], batch["spans"]):
                low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in marked_windows.values.flatten())
                n, spans, kept_sha, first, last = cut_text(text.as_py(), low, high, width)
                rows.append((k1, k2, n, spans, kept_sha, [{"low": a, "high": b} for a, b in zip(first, last)]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*KEY, "n_removed", "n_spans", "kept_sha256", "spans"])

    return both.mapInArrow(work, CUTS)


def cut(df: DataFrame, text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """All rows of ``df`` as one struct ``row``, with ``n_bytes, n_removed, n_spans, kept_sha256`` and the removed ``spans``."""
    found = saved(repeated_spans(df, text_col, width, **options), "cuts")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    rows = rows.select("row", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = rows.select("row", "n_bytes", "sha", *key_of(F.col("sha")))
    zero = F.lit(0).cast("long")
    return rows.join(found, KEY, "left").select(
        "row", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def kept_texts(df: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with the repeated bytes taken out of its texts; bytes of a character that is cut in two become a replacement mark."""
    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, removed in zip(texts, spans):
            raw, at, parts = (text or "").encode(), 0, []
            for span in removed:
                parts.append(raw[at:span["low"]])
                at = span["high"]
            out.append(b"".join([*parts, raw[at:]]).decode(errors="replace") if len(removed) else text)
        return pd.Series(out, dtype=object)

    done = cut(df, text_col, width)
    return done.select(*[rest(F.col(f"row.`{c}`"), "spans").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns])


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that occur twice."""
    done = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
SQL = {}
