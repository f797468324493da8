"""Small state machines over the lines of files, run chunk by chunk from every state at once.

A machine walks the lines of a file in order; what it does with a line depends on its state, on texts it remembers and on
counts.  A chunk in the middle of a file does not know the state it starts in, so it is walked from all states side by
side: walks that meet in the same state and memory go on as one, which is after a few lines as a rule.  What they do to
the memory is kept relative to the start: a text is a new one or still the inherited one, a count is how much was added.

So each chunk becomes a small table from state to state.  These tables, one row for each chunk and state, are composed in
file order, which gives every chunk the state it starts in; its emitted lines are then picked from the walk of that state.
The lines themselves are shuffled and sorted once, and a file is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = ["file", "chunk"]


class Machine:
    """What is walked.  States are numbers from 0, the state at the start of a file; ``step`` may change ``memory`` in place.

    ``memory`` has the remembered texts first and then the counts.  ``step`` gives the new state and whether to emit the line.
    """
    states: int = 1
    texts: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    #: Emit only lines of the first and the last so many values of the first count in each chunk; all where 0.
    ends: int = 0

    def step(self, state: int, memory: list, *line) -> tuple[int, bool]:
        raise NotImplementedError


class Inherited:
    """Stands for a text that was remembered before the chunk began."""


class Walk:
    """One chunk, walked from all states."""

    def __init__(self, machine: Machine):
        self.machine = machine
        memory = [Inherited] * len(machine.texts) + [0] * len(machine.counts)
        self.paths = [(1 << s, s, list(memory)) for s in range(machine.states)]
        self.emitted: list[tuple[int, int, list, int]] = []

    def line(self, at: int, values: tuple) -> None:
        step, moved = self.machine.step, []
        for mask, state, memory in self.paths:
            new, emit = step(state, memory, *values)
            if emit:
                self.emitted.append((at, mask, list(memory), state))
            moved.append((mask, new, memory))
        if len(moved) > 1:
            met: list[tuple[int, int, list]] = []
            for mask, state, memory in moved:
                for i, (other, s, m) in enumerate(met):
                    if s == state and m == memory:
                        met[i] = (other | mask, s, m)
                        break
                else:
                    met.append((mask, state, memory))
            moved = met
        self.paths = moved

    def tops(self) -> list[int]:
        """The first count as it stands on the way from each state."""
        place = len(self.machine.texts)
        return [next(memory[place] for mask, _, memory in self.paths if mask >> state & 1) for state in range(self.machine.states)]


def _arrow(machine: Machine, carried: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [f.with_nullable(True) for f in to_arrow_schema(carried)]
    fields += [pa.field("mask", pa.int32()), pa.field("state", pa.int32()), pa.field("exit", pa.int32())]
    for name in machine.texts:
        fields += [pa.field(f"at_{name}", pa.string()), pa.field(f"old_{name}", pa.bool_())]
    return pa.schema(fields + [pa.field(f"at_{name}", pa.int64()) for name in machine.counts])


def walked(lines: DataFrame, machine: Machine, carry: list[str]) -> DataFrame:
    """Emitted lines and, with ``exit``, one row for each way through a chunk.

    ``lines`` has ``file, chunk, pos``, what the machine reads, and the columns ``carry`` that emitted lines keep.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    columns = list(dict.fromkeys([*CHUNK, "pos", *carry, *machine.reads]))
    keyed = lines.withColumns({"file": F.coalesce("file", F.lit("")), "chunk": F.coalesce("chunk", F.lit(0))}).select(columns)
    kept = list(dict.fromkeys([*CHUNK, "pos", *carry]))
    schema = _arrow(machine, keyed.select(kept).schema)
    texts = len(machine.texts)

    def memory_columns(memories: list[list]) -> list[pa.Array]:
        out = []
        for i in range(texts):
            out.append(pa.array([None if m[i] is Inherited else m[i] for m in memories], pa.string()))
            out.append(pa.array([m[i] is Inherited for m in memories], pa.bool_()))
        return out + [pa.array([m[texts + i] for m in memories], pa.int64()) for i in range(len(machine.counts))]

    def emitted(batch: pa.RecordBatch, walk: Walk) -> list[pa.RecordBatch]:
        """The lines of this batch that the walk emitted since it was asked last."""
        rows, walk.emitted = walk.emitted, []
        if not rows:
            return []
        taken = batch.select(kept).take(pa.array([r[0] for r in rows], pa.int64()))
        numbers = [pa.array([r[i] for r in rows], pa.int32()) for i in (1, 3)]
        return [pa.record_batch([*taken.columns, *numbers, pa.nulls(len(rows), pa.int32()), *memory_columns([r[2] for r in rows])], schema=schema)]

    def at_ends(held: list[pa.RecordBatch], walk: Walk) -> list[pa.RecordBatch]:
        """The held lines that can still be among the first or last values of the first count."""
        tops, out = walk.tops(), []
        for batch in held:
            pairs = zip(batch["mask"].to_pylist(), batch[f"at_{machine.counts[0]}"].to_pylist())
            keep = [n <= machine.ends or any(mask >> s & 1 and n > top - machine.ends for s, top in enumerate(tops)) for mask, n in pairs]
            out.append(batch.filter(pa.array(keep)))
        return out

    def left(ways: list[tuple[str, int, Walk]]) -> pa.RecordBatch:
        """A row for each way through each of the chunks."""
        rows = [(file, chunk, *path) for file, chunk, walk in ways for path in walk.paths]
        head = {"file": [r[0] for r in rows], "chunk": [r[1] for r in rows]}
        fixed = [pa.array(head[c], schema.field(c).type) if c in head else pa.nulls(len(rows), schema.field(c).type) for c in kept]
        numbers = [pa.array([r[2] for r in rows], pa.int32()), pa.nulls(len(rows), pa.int32()), pa.array([r[3] for r in rows], pa.int32())]
        return pa.record_batch([*fixed, *numbers, *memory_columns([r[4] for r in rows])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, Walk(machine)
        held: list[pa.RecordBatch] = []  # of the current chunk
        ways: list[tuple[str, int, Walk]] = []
        for batch in batches:
            files, chunks = batch["file"].to_pylist(), batch["chunk"].to_pylist()
            for at, values in enumerate(zip(*[batch[c].to_pylist() for c in machine.reads])):
                if (files[at], chunks[at]) != key:
                    if key is not None:
                        held += emitted(batch, walk)
                        yield from (at_ends(held, walk) if machine.ends else held)
                        ways.append((*key, walk))
                    key, walk, held = (files[at], chunks[at]), Walk(machine), []
                walk.line(at, values)
            held += emitted(batch, walk)
            if machine.ends:
                held = at_ends(held, walk)
            else:
                yield from held
                held = []
            if ways:
                yield left(ways)
                ways = []
        if key is not None:
            yield from held
            yield left([(*key, walk)])

    sorted_lines = keyed.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "pos")
    return sorted_lines.mapInArrow(work, from_arrow_schema(schema))


def _folded(machine: Machine, ways: DataFrame) -> DataFrame:
    """(file, chunk, entry, exit, in_<memory>, out_<memory>): how each chunk is passed, by composing the tables in file order."""
    from pyspark.sql.pandas.types import from_arrow_schema

    memory = (*machine.texts, *machine.counts)
    texts = len(machine.texts)
    types = [pa.string()] * texts + [pa.int64()] * len(machine.counts)
    schema = pa.schema([pa.field("file", pa.string()), pa.field("chunk", pa.int64()), pa.field("entry", pa.int32()), pa.field("exit", pa.int32()),
                        *[pa.field(f"{side}_{n}", t) for side in ("in", "out") for n, t in zip(memory, types)]])
    columns = [f"{kind}_{n}" for n in machine.texts for kind in ("at", "old")] + [f"at_{n}" for n in machine.counts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, chunk, state, values, done = None, None, 0, [], True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, chunk, state, values = row["file"], None, 0, [None] * texts + [0] * len(machine.counts)
                if row["chunk"] != chunk:
                    chunk, done = row["chunk"], False
                if done or not row["mask"] >> state & 1:
                    continue
                before = (state, *values)
                values = [v if row[f"old_{n}"] else row[f"at_{n}"] for v, n in zip(values, machine.texts)] + [
                    v + row[f"at_{n}"] for v, n in zip(values[texts:], machine.counts)]
                state, done = row["exit"], True
                out.append((file, chunk, before[0], state, *before[1:], *values))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    ordered = ways.select(*CHUNK, "mask", "exit", *columns).repartition("file").sortWithinPartitions(*CHUNK)
    return ordered.mapInArrow(work, from_arrow_schema(schema))


def finals(lines: DataFrame, machine: Machine) -> DataFrame:
    """State and memory at the end of each file, for machines that only remember."""
    return _last(machine, _folded(machine, walked(lines, machine, []).where("exit IS NOT NULL")))


def _last(machine: Machine, passed: DataFrame) -> DataFrame:
    memory = [F.col(f"out_{n}").alias(n) for n in (*machine.texts, *machine.counts)]
    last = passed.groupBy("file").agg(F.max_by(F.struct(F.col("exit").alias("state"), *memory), "chunk").alias("last"))
    return last.select("file", "last.*")


def run(lines: DataFrame, machine: Machine, carry: list[str], totals: bool = False) -> DataFrame:
    """The emitted lines: the columns ``carry``, ``state`` before the line, and the memory behind it under its own names.

    ``totals`` adds ``total_<count>`` and ``final_state`` of the whole file.
    """
    found = walked(lines, machine, carry)
    # One small shuffle of what the walks give, which both uses share; the generated row keeps filters above it.
    shared = found.repartition(*CHUNK).select(F.inline(F.array(F.struct(*found.columns))))
    starts = _folded(machine, shared.where("exit IS NOT NULL"))
    if totals:
        ends = _last(machine, starts).select("file", F.col("state").alias("final_state"), *[F.col(n).alias(f"total_{n}") for n in machine.counts])
        starts = starts.join(ends, "file")
    rows = shared.where("exit IS NULL").drop("exit").join(starts.drop("exit"), CHUNK).where("(shiftright(mask, entry) & 1) = 1")
    kept = list(dict.fromkeys([*CHUNK, "pos", *carry]))
    memory = [F.when(F.col(f"old_{n}"), F.col(f"in_{n}")).otherwise(F.col(f"at_{n}")).alias(n) for n in machine.texts]
    memory += [(F.col(f"in_{n}") + F.col(f"at_{n}")).alias(n) for n in machine.counts]
    return rows.select(*kept, "state", *memory, *[c for c in ("final_state", *[f"total_{n}" for n in machine.counts]) if totals])
