"""Exact k-means over whole-number vectors that skips most distances by geometric bounds.

Every vector keeps its cluster, an upper bound on the distance to its centroid and a lower bound on the distance to all other
centroids.  When centroids move, the upper bound grows by the drift of the own centroid.  The lower bound shrinks by less
than the drift of the others: all vectors of a cluster lie in a sphere around its centroid, and for every other centroid that
moves from a to b the plane through a, b and the centre of the sphere tells how much nearer any point of the sphere can come.

    |x - a| - |x - b| = 2 t |b - a| / (|x - a| + |x - b|) <= |b - a| cos(angle at the middle of a and b between b and x),

with t the way of x along a -> b from the middle; the sphere covers all angles within asin(radius / way to its centre), so the
largest cosine is that of the nearest of them, and never less than nothing is taken.  A vector whose upper bound stays
below its lower bound keeps its cluster without any distance.  Otherwise its upper bound is made exact, and if it is
still ambiguous all centroids are scanned.  Bounds are floating point with a margin that only loosens them; distances that
decide are whole numbers, so the result equals that of plain k-means, ties included.

Each round writes vectors and bounds to the shared folder once, and gets the sums of the clusters from what it wrote; k times
the dimensions of them reach the driver.  A cluster with a third of all vectors is a third of the partial sums of each task.

Vectors count if they have the right number of components, none null or not finite; others have no row in the result.  Beyond
2 ** 27 a component counts as that number, since squared distances must fit into 64 bits.  Vectors without identifier come
last in the choice of the first centroids, equal identifiers in the order of their components; with fewer vectors than
centroids every vector starts one.  Repeated rows count as often as they come.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import saved, table

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
LARGEST = 1 << 27
#: Share by which floating-point bounds are loosened.
MARGIN = 1e-9


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that count, as whole numbers."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("v")).where((F.size("v") == dimensions) & finite)
    bounded = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(1e18)), F.lit(-1e18))), F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.select("vec_id", F.transform("v", bounded).cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and identifier."""
    code = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.lit("none"))
    rows = vectors.select(code.alias("code"), "v").orderBy("code", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector."""
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearer(a: np.ndarray, b: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """How much nearer a point within ``radius`` of ``centre`` can come to a centroid that moves from ``a`` to ``b``, at most."""
    drift = float(np.sqrt(((b - a) ** 2).sum()))
    middle = (a + b) / 2
    way = float(np.sqrt(((centre - middle) ** 2).sum()))
    if drift == 0 or radius >= way:
        return drift
    cosine = float(np.clip(((centre - middle) @ (b - a)) / (way * drift), -1, 1))
    angle = max(0.0, np.arccos(cosine) - np.arcsin(min(1.0, radius / way)) - MARGIN)
    return drift * max(0.0, float(np.cos(angle)))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster: the drift of its centroid, and how much its lower bounds shrink."""
    before, after = old.astype(float), new.astype(float)
    k = len(old)
    drift = np.sqrt(((after - before) ** 2).sum(axis=1))
    shrink = [max((nearer(before[j], after[j], before[i], radius[i]) for j in range(k) if j != i), default=0.0) for i in range(k)]
    return drift * (1 + MARGIN), np.array(shrink) * (1 + MARGIN)


class Step:
    """What a task needs to move one batch of vectors from the old centroids to the new ones."""

    def __init__(self, centroids: np.ndarray, drift: np.ndarray | None = None, shrink: np.ndarray | None = None):
        self.centroids, self.drift, self.shrink = centroids, drift, shrink

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and both bounds from the distances to all centroids; ties go to the smaller number."""
        distances = squared(vectors, self.centroids)
        cluster = distances.argmin(axis=1)
        rows = np.arange(len(vectors))
        upper = np.sqrt(distances[rows, cluster].astype(float)) * (1 + MARGIN)
        distances[rows, cluster] = np.iinfo(np.int64).max
        return cluster, upper, np.sqrt(distances.min(axis=1).astype(float)) * (1 - MARGIN)

    def __call__(self, vectors, cluster, upper, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower, scanned) after the centroids have moved."""
        if self.drift is None:
            return *self.scan(vectors), np.ones(len(vectors), bool)
        upper = upper * (1 + MARGIN) + self.drift[cluster]
        lower = np.maximum(lower * (1 - MARGIN) - self.shrink[cluster], 0)
        cluster, doubt = cluster.copy(), np.flatnonzero(upper >= lower)
        own = ((vectors[doubt] - self.centroids[cluster[doubt]]) ** 2).sum(axis=1)
        upper[doubt] = np.sqrt(own.astype(float)) * (1 + MARGIN)
        doubt = doubt[upper[doubt] >= lower[doubt]]
        if len(doubt):
            cluster[doubt], upper[doubt], lower[doubt] = self.scan(vectors[doubt])
        scanned = np.zeros(len(vectors), bool)
        scanned[doubt] = True
        return cluster, upper, lower, scanned


STATE = {"cluster": (pa.int32(), "int"), "upper": (pa.float64(), "double"), "lower": (pa.float64(), "double"), "scans": (pa.int32(), "int")}


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def moved(state: DataFrame, step: Step, dimensions: int) -> DataFrame:
    """``state`` (vec_id, v, cluster, upper, lower, scans) after one assignment."""
    keep = ["vec_id", "v"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [batch[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
            cluster, upper, lower, scanned = step(matrix(batch["v"], dimensions), *before)
            scans = batch["scans"].to_numpy(zero_copy_only=False) + scanned
            new = [pa.array(x, kind) for x, (kind, _) in zip((cluster, upper, lower, scans), STATE.values())]
            yield pa.record_batch([*(batch[c] for c in keep), *new], names=[*keep, *STATE])

    return state.mapInArrow(work, state.schema)


def cluster_sums(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, dict[int, tuple[int, list[int]]]]:
    """The radius of every cluster, and counts and exact sums of those that are not empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cluster = matrix(batch["v"], dimensions), batch["cluster"].to_numpy()
            upper = batch["upper"].to_numpy()
            rows = []
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                sums = vectors[mine].sum(axis=0).tolist()
                rows += [(c, i, s, int(mine.sum()), float(upper[mine].max())) for i, s in enumerate(sums)]
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "i", "part", "n", "radius"])

    parts = state.select("v", "cluster", "upper").mapInArrow(work, "cluster int, i int, part long, n long, radius double")
    rows = parts.groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    radius, sums = np.zeros(k), {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["i"])):
        radius[r["cluster"]] = r["radius"]
        sums.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return radius, sums


def fitted(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, tighten: bool = True) -> tuple[DataFrame, np.ndarray]:
    """The state after all rounds and the last assignment, and the centroids it belongs to.

    ``tighten=False`` loosens the lower bounds by the full drift; the result is the same.
    """
    centroids = first_centroids(vectors, k, seed)
    blank = {"cluster": 0, "upper": 0.0, "lower": 0.0, "scans": 0}
    state = vectors.select("vec_id", "v", *[F.lit(blank[name]).cast(kind).alias(name) for name, (_, kind) in STATE.items()])
    if not len(centroids):
        return state, centroids
    state = saved(moved(state, Step(centroids), dimensions), "kmeans")
    for _ in range(rounds):
        radius, sums = cluster_sums(state, len(centroids), dimensions)
        new = np.array([[s // sums[c][0] for s in sums[c][1]] if c in sums else old.tolist() for c, old in enumerate(centroids)], np.int64)
        drift, shrink = loosening(centroids, new, radius)
        if not tighten:
            shrink = np.array([max((drift[j] for j in range(len(drift)) if j != i), default=0.0) for i in range(len(drift))])
        centroids = new
        state = saved(moved(state, Step(centroids, drift, shrink), dimensions), "kmeans")
    return state, centroids


def with_distance(state: DataFrame, centroids: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, scans): the exact squared distance of every vector to its centroid."""
    names, kinds = ["vec_id", "cluster", "distance", "scans"], [None, pa.int32(), pa.int64(), pa.int32()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centroids[batch["cluster"].to_numpy()] if batch.num_rows else np.zeros((0, dimensions), np.int64)
            distance = ((matrix(batch["v"], dimensions) - own) ** 2).sum(axis=1)
            yield pa.record_batch([batch["vec_id"], batch["cluster"], pa.array(distance, kinds[2]), batch["scans"]], names=names)

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(work, f"vec_id {kind}, cluster int, distance long, scans int")


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
             dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of every vector that counts."""
    spark = df.sparkSession
    vectors = saved(whole_vectors(df, id_col, vector_col, dimensions, scale), "vectors")
    state, centroids = fitted(vectors, k, rounds, dimensions, seed)
    rows = saved(with_distance(state, centroids, dimensions), "distances")
    # One row for each cluster: at most k reach the driver.
    sums = {r["cluster"]: int(r["inertia"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    code = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    each = spark.createDataFrame([(c, inertia, sum(sums.values()), code(c)) for c, inertia in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(each, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def op12_kmeans(spark, sf_dir: str) -> DataFrame:
    """Cluster, distance and digests of every vector."""
    return clusters(table(spark, sf_dir, "embeddings")).drop("scans")


def _sql() -> str:
    assigned = """{name} AS MATERIALIZED (SELECT vec_id, v, ds, list_position(ds, list_min(ds)) AS c FROM (
  SELECT vec_id, v, [list_sum([(v[i] - o[i]) * (v[i] - o[i]) for i in range(1, 65)])::BIGINT for o in cs] AS ds FROM kept, {cents}))"""
    moved_to = """{cents} AS MATERIALIZED (SELECT list(coalesce(new, old) ORDER BY c) AS cs FROM (SELECT unnest(cs) AS old, unnest(range(1, len(cs) + 1)) AS c FROM {before})
  LEFT JOIN (SELECT c, list(((total - (((total % n) + n) % n)) // n)::BIGINT ORDER BY i) AS new FROM (
    SELECT c, i, sum(x)::HUGEINT AS total, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM {name}) GROUP BY c, i) GROUP BY c) USING (c))"""
    steps = [assigned.format(name="a0", cents="c0")]
    for r in range(1, ROUNDS + 1):
        steps += [moved_to.format(cents=f"c{r}", before=f"c{r - 1}", name=f"a{r - 1}"), assigned.format(name=f"a{r}", cents=f"c{r}")]
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, [greatest(least(floor({SCALE} * x::DOUBLE), {LARGEST}), -{LARGEST})::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT list(v ORDER BY code, v) AS cs FROM (
  SELECT v, coalesce(sha256('{SEED}:' || vec_id::VARCHAR), 'none') AS code FROM kept ORDER BY code, v LIMIT {CLUSTERS})),
{", ".join(steps)},
done AS (SELECT vec_id, (c - 1)::INTEGER AS cluster, ds[c] AS distance, sha256(array_to_string(cs[c], ',')) AS centroid_sha256 FROM a{ROUNDS}, c{ROUNDS})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM done
"""


QUERIES = {"op12_kmeans": op12_kmeans}
SQL = {"op12_kmeans": _sql()}
