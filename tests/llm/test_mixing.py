import random

import duckdb
import pytest
from pyspark.sql import functions as F

from opslens.llm import mixing


def brute_targets(sizes):
    """By rounds: the excess over the caps is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[t] for t in left) for s in order}
        over = {s for s in left if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def brute_apportion(claims, seats):
    quota = [0] * len(claims)
    for _ in range(seats if any(claims) else 0):
        i = max(range(len(claims)), key=lambda i: (claims[i] / (2 * quota[i] + 1), -i))
        quota[i] += 1
    return quota


ROWS = [(i, "word " * (1 + i * 37 % 400), f"s{i % 4}") for i in range(120)] + [(200, None, "s1"), (201, "", None), (202, "one two", None), (203, "x " * 5000, "tiny"), (203, "x " * 5000, "tiny"), (None, "a b c", "s0")]


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "é": 300, "z": 1, None: 40}
    df = spark.createDataFrame([(f"k{s}", s, n) for s, n in sizes.items()], "key STRING, source STRING, source_size LONG")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("claims, seats", [([10, 20, 30], 7), ([1, 1, 1, 1], 2), ([0, 5], 3), ([997, 1, 1, 1], 50), ([3, 3, 3], 0), ([0, 0], 4), ([7], 9)])
def test_apportionment(spark, claims, seats):
    df = spark.createDataFrame([(1, i, float(c), seats) for i, c in enumerate(claims)], "g INT, i INT, claim DOUBLE, seats LONG")
    got = {r["i"]: r["quota"] for r in mixing.apportion(df, ["g"], "claim", "seats", "i").collect()}
    assert [got[i] for i in range(len(claims))] == brute_apportion(claims, seats)


@pytest.mark.parametrize("start, size, blocks, rest, first", [(0, 100, 9, 4, 3), (33, 1, 5, 2, 0), (31, 2, 5, 3, 4), (64, 500, 30, 29, 7), (5, 40, 2, 0, 1), (0, 0, 3, 1, 0)])
def test_taken_within_blocks(spark, start, size, blocks, rest, first):
    chosen = {b for b in range(blocks) if ((b + 1) * rest + first) // blocks > (b * rest + first) // blocks}
    expected = sum((start + i) // mixing.BLOCK in chosen for i in range(size)) if rest else 0
    assert len(chosen) == rest
    columns = [F.lit(v) for v in (start, size, blocks, rest, first)]
    assert spark.range(1).select(mixing.taken_within(*columns)).first()[0] == expected


def test_query_equals_sql_and_holds_the_contract(spark, documents, sf):
    folder = sf(documents=documents(*ROWS))
    got = mixing.op3_source_mix(spark, folder).toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    expected = duck.execute(mixing.SQL["op3_source_mix"]).df()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    as_rows = lambda df: sorted(map(repr, df[key].astype(object).where(df[key].notna(), None).astype(str).itertuples(index=False)))
    assert as_rows(got.astype({"doc_id": "Int64"})) == as_rows(expected.astype({"doc_id": "Int64"}))
    assert len(got) == len(ROWS) and (got.taken <= 3 * got["size"]).all()
    again = mixing.op3_source_mix(spark, folder).toPandas()
    assert as_rows(got.astype({"doc_id": "Int64"})) == as_rows(again.astype({"doc_id": "Int64"}))


def test_mixed_rows_hold_the_taken_words(documents):
    df = documents(*ROWS).withColumn("size", F.lit(1)).withColumn("row", F.lit("x")).withColumn("key", F.lit(2))
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    taken = {(r["doc"], r["source"]): r["taken"] for r in mixing.mix(df, "doc_id", "source", mixing.size_of(F.col("text"))).groupBy(F.col("row.doc_id").alias("doc"), F.col("row.source").alias("source")).agg(F.sum("taken").alias("taken")).collect()}
    got = {(r["doc"], r["source"]): r["n"] for r in mixed.groupBy(F.col("doc_id").alias("doc"), "source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert got == {k: v for k, v in taken.items() if v}
    assert mixed.where("n_chars <> length(text)").isEmpty()


def test_chosen_text_keeps_white_space():
    text = " ".join(f"w{i}" + "\n" * (i % 5 == 0) for i in range(200))
    words = text.split()
    got = mixing.chosen_text(text, 7, 200, 10, 3, 4)
    chosen = [i for i in range(200) if (((7 + i) // 32 + 1) * 3 + 4) // 10 > ((7 + i) // 32 * 3 + 4) // 10]
    assert got.split() == [words[i] for i in chosen] and "\n " in got


def test_small_sources_meet_their_targets(spark, documents, sf):
    """Targets of 15 words up, beside a large source and documents of all lengths."""
    rng = random.Random(3)
    words = lambda n: " ".join(["w"] * n)
    rows, i = [(0, words(40_000), "zz")], 1
    for source, size in {"a5": 5, "b20": 20, "c100": 100, "d300": 300, "e900": 900, "f31": 31, "g32": 32, "h33": 33, "i64": 64}.items():
        while size:
            n = min(size, rng.choice([1, 3, 17, 32, 40, 200]))
            rows.append((i, words(n), source))
            size, i = size - n, i + 1
    folder = sf(documents=documents(*rows))
    got = mixing.op3_source_mix(spark, folder).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[2] for r in rows})
    assert (got.taken <= 3 * got["size"]).all()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 3
    assert dict(got.groupby("source").taken.sum())["a5"] == 15


def test_a_repeated_identifier_is_spread_over_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 500)
    df = documents(*[(7, "w " * (1 + k % 97), "s") for k in range(300)], (8, "w " * 2000, "t"))
    mixed = mixing.mix(df, "doc_id", "source", mixing.size_of(F.col("text")))
    rows = mixed.select("row.source", "size", "target", "taken", "first", "blocks", "cut").toPandas()
    assert len(rows[rows.source == "s"][["first", "blocks", "cut"]].drop_duplicates()) > 10
    for _, part in rows.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 3 and (part.taken <= 3 * part["size"]).all()


def test_names_with_dots(documents):
    df = documents((1, "a b c", "s"), (2, "d e f", "t")).withColumn("x.y", F.lit(5)).withColumnRenamed("n_chars", "n.chars")
    mixed = mixing.mixed_rows(df, n_chars="n.chars")
    assert mixed.columns == df.columns and {r["x.y"] for r in mixed.collect()} == {5}


def test_empty_table(documents):
    empty = documents((1, "x")).where("false")
    assert mixing.mixed_rows(empty).isEmpty()
    assert mixing.mixed_rows(documents((1, None), (2, " "))).isEmpty()
