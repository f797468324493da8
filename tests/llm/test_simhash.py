"""SimHash near duplicates against brute force."""
import random
import re

import numpy as np
import pytest
import xxhash

from opslens.llm import golay, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def near_texts(count, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = simhash.op2_simhash_dedup(spark, SF).toPandas()
    prints = {i: brute_fingerprint(t) for i, t in zip(documents.doc_id, documents.text)}
    assert {i: int(f, 16) for i, f in zip(got.doc_id, got.fingerprint)} == prints
    ids = list(prints)
    expected = brute_components(ids, lambda i, j: (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 3)
    assert dict(zip(got.doc_id, got.component_id)) == expected


@pytest.mark.parametrize("block_rows", [2, 7, 4096])
def test_overlong_keys_lose_no_link(documents, block_rows):
    texts = near_texts(60)
    df = documents(*enumerate(texts))
    got = {r["id"]: r["component"] for r in simhash.components(df, simhash.EXACT64, block_rows=block_rows).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert got == brute_components(range(60), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)


def test_rows_of_every_kind(documents):
    df = documents((5, None), (3, ""), (9, " \t"), (4, "One two"), (7, "one TWO"), (7, "one TWO"), (None, "one two"), (None, "a b c d"))
    got = sorted(((r["id"], r["component"]) for r in simhash.components(df, simhash.EXACT64).collect()), key=repr)
    assert got == sorted([(None, None), (None, 4), (3, 3), (4, 4), (5, 3), (7, 4), (7, 4), (9, 3)], key=repr)


def test_empty_table(documents, spark):
    empty = documents((1, "x")).where("false")
    assert simhash.components(empty, simhash.EXACT64).count() == 0
    assert simhash.one_of_each(empty, simhash.EXACT64).columns == empty.columns


def test_golay_keys_shared_within_two_bits():
    rng = np.random.default_rng(5)
    for v in rng.integers(0, 1 << 23, 40):
        flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
        one, more = golay.indices(np.array([v ^ f for f in flips]))
        keys = [{int(a), *map(int, b)} for a, b in zip(one, more)]
        assert all(k & keys[0] for k in keys)


def test_three_errors_share_a_key():
    rng = random.Random(9)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for place in rng.sample(range(64), 3):
            b ^= 1 << place
        fps = simhash.as_matrix([a.to_bytes(8, "big"), b.to_bytes(8, "big")], 8)
        at, keys = simhash.key_rows(fps, simhash.EXACT64)
        assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())


def test_star_family_loses_no_link(documents):
    """Copies within three bits of their original, not of each other, are one group; what is four bits away is not."""
    prints = [0] + [1 << i | 1 << (i + 1) | 1 << (i + 2) for i in range(0, 60, 3)] + [0b1111 << 40]
    fps = simhash.as_matrix([p.to_bytes(8, "big") for p in prints], 8).view(np.uint64)
    forest = simhash.Forest(fps, simhash.EXACT64)
    a, b = np.triu_indices(len(prints), 1)
    forest.look(a, b)
    expected = brute_components(range(len(prints)), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert forest.parent.tolist() == [expected[i] for i in range(len(prints))]


def test_one_of_each(documents):
    texts = near_texts(40, seed=8)
    prints = [brute_fingerprint(t) for t in texts]
    rows = list(enumerate(texts))
    kept = simhash.one_of_each(documents(*rows, rows[3], (None, texts[0]), (99, None), (98, "")), simhash.EXACT64)
    smallest = set(brute_components(range(40), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3).values())
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(smallest | {98})


def test_names_that_an_operator_might_use_itself(documents):
    df = documents((2, "a b c"), (1, "a b c"), (3, "other words here")).selectExpr("doc_id", "text", "'x' AS __id", "7 AS __row", "lang AS hash", "n_chars AS `a.b`")
    kept = simhash.one_of_each(df, simhash.EXACT64)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c", "x", 7, "en", 5), (3, "other words here", "x", 7, "en", 16)]


def test_very_long_text(documents):
    long = " ".join(f"w{i}" for i in range(200_000))
    got = {r["id"]: r["component"] for r in simhash.components(documents((1, long), (2, long + " end"), (3, "short")), simhash.EXACT64).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_clashing_columns(documents):
    df = documents((1, "a b c"), (2, "a b c")).selectExpr("doc_id", "text", "n_chars AS fp", "n_chars AS node", "n_chars AS n", "lang AS id", "lang AS row")
    kept = simhash.one_of_each(df, simhash.EXACT64)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
