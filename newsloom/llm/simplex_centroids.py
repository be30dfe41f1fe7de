"""Centroid clustering of integer vectors, with centroids filtered by N-simplex projection.

A few of the starting centroids are pivots. Every vector's squared distances to them are computed once and stored.
By the pivots' simplex these distances become the coordinates of an apex: its foot in the pivots' space and its height
above it. A centroid gets an apex in the same way. The Euclidean distance of two apexes bounds the true distance from
below, and that with one height reflected bounds it from above, so a centroid whose lower bound passes the least upper
bound can not be nearest. What is left is compared in whole numbers; ties go to the smaller number.

A round is one job over the stored table: tasks add up their clusters, and 65 sums per cluster meet. Only centroids
and those sums reach the driver, at most CENTROIDS of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import fresh_dir

SIZE, SCALE, CENTROIDS, ROUNDS, PIVOTS = 64, 256, 40, 5, 16
#: Squared distances of components up to this fit into 64 bits.
LARGEST = 1 << 26
#: A pivot must stand this much above the simplex of those before it, against the longest edge.
LEAST_HEIGHT = 0.02
#: Slack of the bounds against rounding, far above it.
SLACK = 1e-7


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the integer vectors of rows with exactly SIZE components, none null or non-finite."""
    e = F.col(embedding)
    fine = F.coalesce((F.size(e) == SIZE) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))
    large = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling: distances would not fit into 64 bits")).cast("int")
    whole = lambda x: F.when(F.abs(x.cast("double")) * SCALE < LARGEST, F.floor(x.cast("double") * SCALE).cast("int")).otherwise(large)
    return vectors.where(fine).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(e, whole).alias("v"))


def start(kept: DataFrame, most: int = CENTROIDS) -> np.ndarray:
    """The vectors with the least hashes of their ids, in that order (repeated ids by their components); fewer if there are fewer."""
    mark = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(most).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, SIZE)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of y."""
    out = np.empty((len(x), len(y)), dtype=np.int64)
    for k, row in enumerate(y):
        step = x - row
        out[:, k] = np.einsum("ij,ij->i", step, step)
    return out


@dataclass
class Simplex:
    """Pivots (rows of integers) and the inverse of the lower triangle of their simplex, its first vertex at the origin."""

    pivots: np.ndarray
    edges: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def of(points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Pivots among the points: the first, then always the one that stands highest above the simplex so far."""
        chosen, triangle = [0], np.zeros((0, 0))
        if len(points) == 0:
            raise ValueError("no points")
        far = squared(points, points[:1]).astype(np.float64)
        scale = max(float(far.max()), 1.0)
        feet = np.zeros((len(points), 0))
        while len(chosen) < most:
            heights = far[:, 0] - (feet**2).sum(axis=1)
            k = int(heights.argmax())
            if heights[k] <= LEAST_HEIGHT**2 * scale:
                break
            # The new vertex is (its foot, its height): a new row of the triangle.
            row = np.concatenate([feet[k], [np.sqrt(heights[k])]])
            triangle = np.block([[triangle, np.zeros((len(triangle), 1))], [row[None]]])
            edge = squared(points, points[[k]]).astype(np.float64)[:, 0]
            along = (far[:, 0] + far[k, 0] - edge) / 2  # inner products with the edge to the new vertex
            feet = np.concatenate([feet, ((along - feet @ row[:-1]) / row[-1])[:, None]], axis=1)
            chosen.append(k)
        pivots = points[chosen]
        edges = squared(pivots[:1], pivots)[0].astype(np.float64)
        return Simplex(pivots, edges, np.linalg.inv(triangle) if len(triangle) else triangle)

    def apexes(self, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feet, heights) from squared distances to the pivots."""
        d = distances.astype(np.float64)
        along = (d[:, :1] + self.edges[None, 1:] - d[:, 1:]) / 2
        feet = along @ self.inverse.T
        return feet, np.sqrt(np.maximum(d[:, 0] - (feet**2).sum(axis=1), 0))


def nearest(v: np.ndarray, distances: np.ndarray, centroids: np.ndarray, simplex: Simplex, pairs: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of every row, and how many pairs were compared in whole numbers."""
    to_pivots = squared(centroids, simplex.pivots)
    foot, height = simplex.apexes(distances)
    c_foot, c_height = simplex.apexes(to_pivots)
    # Foot and height together have the length of the distance to the first pivot.
    both = distances[:, :1].astype(np.float64) + to_pivots[:, 0].astype(np.float64)[None]
    inner, reflected = foot @ c_foot.T, np.outer(height, c_height)
    upper = both - 2 * (inner - reflected) + SLACK * (both + 1)
    lower = both - 2 * (inner + reflected) - SLACK * (both + 1)
    row, of = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
    exact = np.empty(len(row), dtype=np.int64)
    for k in range(0, len(row), pairs):
        step = v[row[k : k + pairs]].astype(np.int64) - centroids[of[k : k + pairs]]
        exact[k : k + pairs] = np.einsum("ij,ij->i", step, step)
    if not len(row):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    # Pairs are ordered by row and centroid; every row has one at least.
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(exact, first)
    hit = np.flatnonzero(exact == least[row])
    return of[hit[np.searchsorted(row[hit], np.arange(len(v)))]], least, len(row)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def with_distances(kept: DataFrame, simplex: Simplex) -> DataFrame:
    """(vec_id, v, d): with the squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            d = squared(_numbers(b.column(1), SIZE).astype(np.int64), simplex.pivots)
            ends = pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.list_(pa.int32())), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=["vec_id", "v", "d"])

    return kept.mapInArrow(run, "vec_id bigint, v array<int>, d array<bigint>")


def _moved(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after a round; empty ones stay."""
    width = len(simplex.pivots)
    shared = table.sparkSession.sparkContext.broadcast((centroids, simplex))  # CENTROIDS x SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s = shared.value
        sums, counts = np.zeros((len(c), SIZE), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for b in _slices(batches):
            v = _numbers(b.column(0), SIZE).astype(np.int64)
            of, _, _ = nearest(v, _numbers(b.column(1), width), c, s)
            order = np.argsort(of, kind="stable")
            kinds, begin = np.unique(of[order], return_index=True)
            sums[kinds] += np.add.reduceat(v[order], begin)
            counts += np.bincount(of, minlength=len(c))
        some = np.flatnonzero(counts)
        rows = np.concatenate([sums[some], counts[some, None]], axis=1)
        n = SIZE + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, n), pa.int32()), pa.array(np.tile(np.arange(n), len(some)), pa.int32()), pa.array(rows.ravel())], names=["c", "i", "x"])

    parts = table.select("v", "d").mapInArrow(run, "c int, i int, x bigint")
    found = parts.groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums = {(r["c"], r["i"]): int(r["x"]) for r in found}
    out = centroids.copy()
    for c in {k for k, _ in sums}:
        out[c] = [sums[c, i] // sums[c, SIZE] for i in range(SIZE)]
    shared.destroy()
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row per kept vector.

    Vectors of another length, or with a null or non-finite component, are left out; a null vec_id is an id like any
    other; repeated rows are clustered each. With fewer than `k` vectors each starts a cluster. An empty table gives no
    row. A component of 2 ** 26 or more after scaling is an error, as its distances would pass 64 bits.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, vec_id, embedding)
    centroids = start(kept, k)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    simplex, folder = Simplex.of(centroids, pivots), fresh_dir(spark, "simplex")
    width = len(simplex.pivots)
    with_distances(kept, simplex).write.parquet(f"{folder}/vectors")
    table = spark.read.schema("vec_id bigint, v array<int>, d array<bigint>").parquet(f"{folder}/vectors")
    for _ in range(rounds):
        centroids = _moved(table, centroids, simplex)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            of, d, _ = nearest(_numbers(b.column(1), SIZE).astype(np.int64), _numbers(b.column(2), width), centroids, simplex)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    table.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint").write.parquet(f"{folder}/assigned")
    assigned = spark.read.schema("vec_id bigint, cluster int, distance bigint").parquet(f"{folder}/assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(sums.values()), texts[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, t string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("t", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per cluster


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same clusters by plain comparison with every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, min(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT rid, vec_id, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, m)])::BIGINT AS d FROM v, c{r}) GROUP BY rid)"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS MATERIALIZED (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range({SIZE})) AS i FROM a{r} JOIN v USING (rid)) GROUP BY 1, 2),
m{r} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN m{r} n USING (c))"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (c)"""
