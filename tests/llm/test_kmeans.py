import hashlib
import random

import duckdb
import numpy as np
import pytest

from opslens.llm import kmeans

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT"


def by_hand(rows, k=16, rounds=3):
    """Plain k-means on Python integers."""
    floor = lambda x: max(-kmeans.LARGEST, min(kmeans.LARGEST, int(np.floor(64 * x))))
    kept = [(i, [floor(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    code = lambda i: "none" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (code(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        mine = assign()
        for c in range(len(centroids)):
            members = [v for (_, v), m in zip(kept, mine) if m == c]
            if members:
                centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    final = assign()
    far = [distance(v, centroids[c]) for (_, v), c in zip(kept, final)]
    return sorted(((i, c, d, sum(e for e, m in zip(far, final) if m == c), sum(far), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), c, d in zip(kept, final, far)), key=repr)


def vectors(n, seed, centres=9, spread=0.15):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middle)]) for i in range(n)]


ODD = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 63 + [None]), (1004, [0.5] * 63 + [float("nan")]), (1005, [float("inf")] * 64),
       (None, [0.25] * 64), (None, [-0.25] * 64), (3, [0.1] * 64), (3, [0.1] * 64), (1006, [3e300] + [0.0] * 63), (1007, [0.0] * 64), (1008, [-0.0] * 64)]


@pytest.mark.parametrize("rows", [vectors(300, 1), vectors(200, 2) + ODD, vectors(5, 3), [(i, [0.5] * 64) for i in range(40)], vectors(120, 4, spread=1.0)])
def test_query_equals_plain_k_means_and_sql(spark, sf, rows):
    folder = sf(embeddings=spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3))
    got = kmeans.op12_kmeans(spark, folder)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == by_hand(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert found == sorted(duck.execute(kmeans.SQL["op12_kmeans"]).fetchall(), key=repr)


def test_no_point_of_the_sphere_comes_nearer_than_the_bound():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b, centre = rng.normal(size=(3, 6)) * rng.uniform(0.1, 5, size=(3, 1))
        radius = rng.uniform(0, 4)
        points = rng.normal(size=(400, 6))
        points = centre + points / np.linalg.norm(points, axis=1)[:, None] * radius * rng.uniform(0, 1, (400, 1)) ** 0.2
        gain = np.linalg.norm(points - a, axis=1) - np.linalg.norm(points - b, axis=1)
        bound = kmeans.nearer(a, b, centre, radius)
        assert gain.max() <= bound + 1e-9 and bound <= np.linalg.norm(b - a) + 1e-9


def test_tightening_scans_less_than_full_drift(spark):
    rows = spark.createDataFrame([(i, v, 0) for i, v in vectors(1500, 7, centres=16, spread=0.3)], SCHEMA)
    whole = kmeans.whole_vectors(rows, "vec_id", "embedding", 64, 64)
    scans, clusters = [], []
    for tighten in (True, False):
        state, centroids = kmeans.fitted(whole, tighten=tighten)
        found = state.toPandas().sort_values("vec_id")
        scans.append(found["scans"].sum())
        clusters.append(found["cluster"].tolist())
    assert clusters[0] == clusters[1] and scans[0] < scans[1] < 4 * 1500


def test_empty_table_and_other_names(spark):
    empty = spark.createDataFrame([], "id STRING, v ARRAY<FLOAT>, cluster STRING")
    assert kmeans.clusters(empty, "id", "v").collect() == []
    named = spark.createDataFrame([(f"k{i}", v, "c") for i, v in vectors(20, 8)], "`an.id` STRING, v ARRAY<FLOAT>, cluster STRING")
    assert kmeans.clusters(named, "an.id", "v", k=3).count() == 20
