"""Reduction per key by a function of the user's own.

The function takes two values and gives one; like the functions of any map-reduce job it must not care about order or grouping
(associative and commutative).  Values are reduced where they lie first, then by parts of a key, then by key, so a key with
a third of all rows is a handful of rows by the time it meets in one task.  Null values are left out; a key with no other
values keeps a null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.keyed_sum import KEY, VALUE
from opslens.session import scratch_dir

#: Keys that a task remembers before it hands on what it has.
KEYS = 100_000
#: Parts of a key in the second step.
PARTS = 64
#: Values that one group of a SQL reduction takes, about.
FAN = 512


def _schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(KEY, VALUE).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _where_they_lie(df: DataFrame, reduce: Callable) -> DataFrame:
    """One value for each key and task, or more where a task sees very many keys."""
    schema = _schema(df)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, value in zip(batch[KEY].to_pylist(), batch[VALUE].to_pylist()):
                before = held.get(key)
                held[key] = value if before is None else before if value is None else reduce(before, value)
            if len(held) > KEYS:
                yield _batch(list(held.items()), schema)
                held = {}
        if held:
            yield _batch(list(held.items()), schema)

    return df.select(KEY, VALUE).mapInArrow(work, df.select(KEY, VALUE).schema)


def _by_key(df: DataFrame, reduce: Callable, *parts: Column) -> DataFrame:
    """One value for each key and part: values arrive in key order, and one is held at a time."""
    schema, part = _schema(df), [p.alias(f"part{i}") for i, p in enumerate(parts)]
    names = [f"part{i}" for i in range(len(parts))]
    dealt = df.select(KEY, VALUE, *part).repartition(KEY, *names).sortWithinPartitions(KEY, *names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for key, value in zip(batch[KEY].to_pylist(), batch[VALUE].to_pylist()):
                if held is None or held[0] != key:
                    if held is not None:
                        rows.append(held)
                    held = (key, value)
                elif value is not None:
                    held = (key, value if held[1] is None else reduce(held[1], value))
            if rows:
                yield _batch(rows, schema)
                rows = []
        if held is not None:
            yield _batch([held], schema)

    return dealt.select(KEY, VALUE).mapInArrow(work, df.select(KEY, VALUE).schema)


def merge_by_key(totals: DataFrame, reduce: Callable) -> DataFrame:
    """(_id, value) with one row for each key, by a Python function of two values."""
    near = _where_they_lie(totals, reduce)
    spread = _by_key(near, reduce, F.spark_partition_id() % PARTS)
    return _by_key(spread, reduce)


def reduce_by_key(rows: DataFrame, key: Column, value: Column, reduce: Callable) -> DataFrame:
    """Maps each row to (key, value) and reduces per key with a Python function of two values."""
    return merge_by_key(rows.select(key.alias(KEY), value.alias(VALUE)), reduce)


def merge_by_key_sql(totals: DataFrame, reduce: Callable[[Column, Column], Column]) -> DataFrame:
    """The same with a function of two columns, which stays in the engine.

    Rows are numbered in a table that is written first.  While a key has more than about ``FAN`` values, these are dealt to groups
    by a hash of their numbers, and each group becomes one value.
    """
    spark = totals.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "reduce")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def reduced(df: DataFrame, *by: str | Column) -> DataFrame:
        values = F.collect_list(VALUE).alias("values")  # leaves nulls out
        groups = df.groupBy(KEY, *by).agg(values, F.min("n").alias("n"))
        kind = df.schema[VALUE].dataType
        one = F.aggregate(F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0))), F.get("values", F.lit(0)), lambda a, b: reduce(a, b).cast(kind))
        return groups.select(KEY, one.alias(VALUE), "n")

    state = written(totals.select(KEY, VALUE, F.monotonically_increasing_id().alias("n")))
    while (most := state.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0) > FAN:
        state = written(reduced(state, F.pmod(F.xxhash64("n"), F.lit(-(-most // FAN))).alias("part")))
    return reduced(state).select(KEY, VALUE)
