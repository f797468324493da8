"""Documents and predicates made from a shape, and staging rows for the keyed sums.

A shape maps a field to ``"int"``, ``"string"``, ``"ObjectId"``, ``["rand-int", "lte"]``,
``["rand"]`` or a nested shape, as ``workload.schema_fields`` reports them.  Random values
come from a hash of the row id, so a lost task makes the same rows again.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generators.
RANDOM_LIMIT = 1000
OTHER_VECTOR = 10001
STAGING_LIMIT = 1_000_000
# A prime and a multiplier whose products stay below 2 ** 63.
PRIME = (1 << 31) - 1
MULTIPLIER = 48271


def _hash(*parts: Column | str | int) -> Column:
    """A whole number below ``PRIME`` from numbers and names, in arithmetic that other engines have as well."""
    h = F.lit(1).cast("bigint")
    for part in parts:
        n = F.pmod(part.cast("bigint"), F.lit(PRIME)) if isinstance(part, Column) else F.lit(name_number(part))
        h = (h * MULTIPLIER + n) % PRIME
    return (h * h + h * MULTIPLIER + 11) % PRIME


def name_number(part: str | int) -> int:
    return (zlib.crc32(part.encode()) if isinstance(part, str) else part) % PRIME


def _random_int(n: Column, field: str, seed: int, limit: int) -> Column:
    return _hash(n, field, seed) % limit


def value_for(kind, n: Column, field: str, seed: int, query: bool = False) -> Column:
    if isinstance(kind, dict):
        return document_for(kind, n, seed, path=f"{field}.")
    if isinstance(kind, (list, tuple)):
        if "rand-int" in kind:
            value = _random_int(n, field, seed, RANDOM_LIMIT)
            return F.struct(value.alias("$lte")) if query and "lte" in kind else value
        if "rand" in kind:
            return (_hash(n, field, seed) + _hash(n, field, seed + 1) / float(PRIME)) / float(PRIME) * RANDOM_LIMIT
        return F.lit(OTHER_VECTOR)
    if kind == "ObjectId":
        return F.concat(F.lit("ObjectId("), n.cast("string"), F.lit(")"))
    if kind == "string":
        return F.concat(F.lit("string_"), n.cast("string"))
    return n


def document_for(shape: dict, n: Column, seed: int, query: bool = False, path: str = "") -> Column:
    return F.struct(*[value_for(kind, n, path + field, seed, query).alias(field) for field, kind in shape.items()])


def documents_for(ids: DataFrame, id_column: str, shape: dict, seed: int = 0, query: bool = False) -> DataFrame:
    """One document per id: ``_id`` and the fields of the shape."""
    n = F.col(id_column)
    return ids.select(n.alias("_id"), document_for(shape, n, seed, query).alias("doc")).select("_id", "doc.*")


def gen_docs(spark: SparkSession, shape: dict, n: int, start: int = 0, seed: int = 0, query: bool = False) -> DataFrame:
    return documents_for(spark.range(start, start + n), "id", shape, seed, query)


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet") -> None:
    docs.write.mode("overwrite").format(fmt).save(path)


def staging_rows(uids: DataFrame, uid: str, statuses: int = 5, writers: int = 10, seed: int = 0) -> DataFrame:
    """``uid, status, writer, amount``: every writer adds every status for every uid."""
    rows = uids.select(F.col(uid).alias("uid"), F.explode(F.sequence(F.lit(0), F.lit(writers - 1))).alias("writer"))
    rows = rows.select("uid", "writer", F.explode(F.sequence(F.lit(0), F.lit(statuses - 1))).alias("status"))
    amount = _hash(F.col("uid"), F.col("writer"), F.col("status"), seed) % STAGING_LIMIT
    return rows.withColumn("amount", amount)


def gen_staging(spark: SparkSession, n_uids: int = 200_000, **options) -> DataFrame:
    return staging_rows(spark.range(n_uids), "id", **options)


def schema_of(fields: dict[str, str]) -> dict:
    """A shape from the types of ``workload.schema_fields`` for one query shape."""
    return {name: kind.split(" ") if kind.startswith("rand") else kind for name, kind in fields.items()}


def index_of(shape: dict) -> dict:
    """Index over every field of a shape, nested fields by their path."""
    keys: dict[str, int] = {}
    for name, kind in shape.items():
        keys.update({f"{name}.{k}": v for k, v in index_of(kind).items()} if isinstance(kind, dict) else {name: 1})
    return keys
