"""A kept index of vectors in inverted lists: built once, added to, probed, and searched exactly within a radius.

Vectors are scaled to length one, so a cosine of t is a distance of sqrt(2 - 2t). Equal vectors of a block are
stored once, under the least id, with a table of members. A list holds what is nearest to its centroid, with its distance
to it (its radius); the tables lie under a folder, lists as table partitions:

    centroids   list, centroid                     (at most MOST_LISTS rows)
    lists       list=..: id, block, unit, radius
    members     id, rep

A radius search needs no list q for x if the triangle inequality says that all of q is too far: |x - c_q| - r must not
pass the largest radius of q, nor r fall short of the distance from x to the plane between its own centroid and c_q. Inside a
list only residents whose radius differs from |x - c_q| by r at most are compared. So `within` and `pairs` are exact at any
number of lists; `probe` looks into the nearest lists only and is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_LISTS = 4096
#: Rows of a block of products; lists are dealt out in chunks of so many.
CHUNK = 2000
#: Rows of a side of a task of `_meet`, which compares them in blocks of CHUNK: a row is sent to each task of its list, so these are few.
TILE = 16_000
#: Room for rounding at the bounds.
SLACK = 1e-6


def units(vectors: DataFrame) -> DataFrame:
    """(id, block, unit): vectors of length one; null vectors and those of length zero or without a finite length are left out."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.select("id", "block", "embedding", norm.alias("_n")).where("_n > 0 AND _n < double('infinity')")
    return rows.select("id", "block", F.transform("embedding", lambda x: x.cast("double") / F.col("_n")).alias("unit"))


def _lloyd(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // CHUNK))])
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to unit centroids."""
    return np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str

    @staticmethod
    def build(vectors: DataFrame, folder: str, lists: int | None = None, sample: int = 20_000, rounds: int = 5, seed: int = 5) -> VectorIndex:
        """Index (id, embedding, block). Centroids come from a sample of at most about `sample` vectors; every vector is indexed."""
        index = VectorIndex(vectors.sparkSession, folder)
        u = units(vectors)
        u.write.mode("overwrite").parquet(f"{folder}/units")  # vectors may be costly to make
        u = index.spark.read.schema(u.schema).parquet(f"{folder}/units")
        reps = _copies(u)
        n = reps.count()
        lists = lists or max(1, min(MOST_LISTS, -(-n // CHUNK)))
        share = F.pmod(F.xxhash64("id", "block"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1))
        rows = reps.where(share).select("unit").limit(2 * sample).collect()
        c = _lloyd(np.array(sorted(r["unit"] for r in rows)), lists, rounds, seed) if rows else np.zeros((0, 1))
        index.spark.createDataFrame([(k, x) for k, x in enumerate(c.tolist())], "list int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")
        index._put(reps, u, c, "overwrite")
        return index

    def insert(self, vectors: DataFrame) -> None:
        """Adds vectors of new ids to the lists of the centroids there are; copies of indexed ones become members."""
        u = units(vectors).join(self.members.select("id"), "id", "left_anti")
        known = self.lists.select("block", "unit", F.col("id").alias("_rep"))
        j = u.join(known, u["block"].eqNullSafe(known["block"]) & (u["unit"] == known["unit"]), "left").select(u["*"], "_rep")
        j = j.persist()
        j.where("_rep IS NOT NULL").select("id", F.col("_rep").alias("rep")).write.mode("append").parquet(f"{self.folder}/members")
        fresh = j.where("_rep IS NULL").drop("_rep")
        self._put(_copies(fresh), fresh, self.centroids(), "append")
        j.unpersist()

    def _put(self, reps: DataFrame, all_: DataFrame, c: np.ndarray, mode: str) -> None:
        spread = self.spark.sparkContext.broadcast(c)  # MOST_LISTS centroids at most

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = _distances(np.stack(pdf.unit.to_list()), spread.value)
                    of = d.argmin(axis=1)
                    yield pdf.assign(radius=d[np.arange(len(d)), of], list=of)

        kind = dict(reps.dtypes)
        made = reps.select("id", "block", "unit").mapInPandas(assign, f"id {kind['id']}, block {kind['block']}, unit array<double>, radius double, list int")
        made.repartition("list").write.mode(mode).partitionBy("list").parquet(f"{self.folder}/lists")
        same = all_["block"].eqNullSafe(reps["block"]) & (all_["unit"] == reps["unit"])
        all_.join(reps.select("block", "unit", F.col("id").alias("rep")), same).select("id", "rep").write.mode(mode).parquet(f"{self.folder}/members")

    @property
    def lists(self) -> DataFrame:
        kinds = self.spark.read.parquet(f"{self.folder}/units").schema.add("radius", "double").add("list", "integer")  # without rows there are no files to tell it
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/lists")

    @property
    def members(self) -> DataFrame:
        """(id, rep): every indexed id; a vector without copies stands for itself."""
        return self.spark.read.parquet(f"{self.folder}/members")

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("list").collect()
        return np.array([r["centroid"] for r in rows])

    def _visits(self, rows: DataFrame, radius: float | None, ahead: bool, nearest: int = 0) -> DataFrame:
        """Rows (id, block, unit) with each list that they must see, and the distance to its centroid."""
        reach = {r["list"]: r["r"] for r in self.lists.groupBy("list").agg(F.max("radius").alias("r")).collect()}
        c = self.centroids()
        far = np.array([reach.get(k, -np.inf) for k in range(len(c))])
        spread = self.spark.sparkContext.broadcast((c, far, _distances(c, c) if len(c) else c))

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, far, between = spread.value
            for pdf in batches if len(c) else ():
                for k in range(0, len(pdf), 512):
                    part = pdf.iloc[k : k + 512]
                    d = _distances(np.stack(part.unit.to_list()), c)
                    own = d.argmin(axis=1)
                    if nearest:
                        seen = np.zeros(d.shape, dtype=bool)
                        held = np.where(np.isfinite(far)[None], d, np.inf)
                        np.put_along_axis(seen, np.argsort(held, axis=1, kind="stable")[:, :nearest], True, axis=1)
                        seen &= np.isfinite(far)[None]
                    else:
                        seen = d - far[None] <= radius + SLACK
                        gap = np.maximum(between[own], 1e-12)
                        plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap)
                        seen &= (plane <= radius + SLACK) | (np.arange(len(c))[None] == own[:, None])
                    if ahead:
                        seen &= np.arange(len(c))[None] >= own[:, None]  # the other side sees the rest
                    row, of = np.nonzero(seen)
                    yield pd.DataFrame({"id": part.id.to_numpy()[row], "block": part.block.to_numpy()[row], "unit": [part.unit.iloc[i] for i in row], "list": of.astype(np.int32), "d": d[row, of], "own": own[row].astype(np.int32)})

        kind = dict(rows.dtypes)
        return rows.select("id", "block", "unit").mapInPandas(go, f"id {kind['id']}, block {kind['block']}, unit array<double>, list int, d double, own int")

    def _meet(self, visits: DataFrame, threshold: float, radius: float, itself: bool) -> DataFrame:
        """(a, b, sim): visitors a and residents b of a list, of one block, at the threshold or more; chunks of both sides meet in tasks of their own."""
        home = self.lists.withColumn("block", F.col("block").cast("string"))
        visits = visits.withColumn("block", F.col("block").cast("string"))
        chunks = lambda df, n: df.groupBy("block", "list").agg(F.ceil(F.count("*") / TILE).cast("int").alias(n))
        n_home, n_visit = chunks(home, "_nh"), chunks(visits, "_nv")
        sizes = n_home.join(n_visit, n_home["block"].eqNullSafe(n_visit["block"]) & (n_home["list"] == n_visit["list"])).select(n_home["block"].alias("_b"), n_home["list"].alias("_l"), "_nh", "_nv")

        def placed(df: DataFrame, mine: str, other: str, side: int) -> DataFrame:
            d = F.col("d") if side == 0 else F.col("radius")
            own = F.col("own") if side == 0 else F.col("list")
            j = df.join(sizes, df["block"].eqNullSafe(sizes["_b"]) & (df["list"] == sizes["_l"]))
            at = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")
            there = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_t")
            j = j.select("id", "block", "unit", "list", d.alias("d"), own.alias("own"), at.alias("_m"), there)
            v, h = ("_m", "_t") if side == 0 else ("_t", "_m")
            return j.select("id", "block", "unit", "list", "d", "own", F.col(v).alias("v"), F.col(h).alias("h"), F.lit(side).alias("side"))

        both = placed(visits, "_nv", "_nh", 0).unionByName(placed(home, "_nh", "_nv", 1))

        def task(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
            if not len(x) or not len(y):
                return pd.DataFrame({"a": [], "b": [], "sim": []})
            u, w, made = np.stack(x.unit.to_list()), np.stack(y.unit.to_list()), []
            dx, dy, ox, oy, ix, iy = x.d.to_numpy(), y.d.to_numpy(), x.own.to_numpy(), y.own.to_numpy(), x.id.to_numpy(), y.id.to_numpy()
            for k in range(0, len(u), CHUNK // 4):  # only a block of the products is held
                for m in range(0, len(w), CHUNK):
                    sim = u[k : k + CHUNK // 4] @ w[m : m + CHUNK].T
                    i, j = np.nonzero(sim >= threshold)
                    sim = sim[i, j]
                    i, j = i + k, j + m
                    hit = np.abs(dx[i] - dy[j]) <= radius + SLACK
                    if itself:  # inside a list each pair once
                        hit &= (ox[i] != oy[j]) | (ix[i] < iy[j])
                    made.append((ix[i[hit]], iy[j[hit]], np.minimum(sim[hit], 1.0)))
            a, b, sim = (np.concatenate(z) for z in zip(*made))
            return pd.DataFrame({"a": a, "b": b, "sim": sim})

        kind = dict(visits.dtypes)["id"]
        return both.groupBy("block", "list", "v", "h").applyInPandas(task, f"a {kind}, b {kind}, sim double")

    def within(self, queries: DataFrame, threshold: float) -> DataFrame:
        """(a, b, sim): for queries a (id, embedding, block) all indexed representatives b of their block at the threshold or more. Exact."""
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        return self._meet(self._visits(units(queries), radius, False), threshold, radius, False)

    def pairs(self, threshold: float) -> DataFrame:
        """(a, b, sim), a < b: all pairs of different vectors of a block at the threshold or more, as representatives. Exact."""
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        met = self._meet(self._visits(self.lists, radius, True), threshold, radius, True)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")

    def probe(self, queries: DataFrame, lists: int = 4, top: int = 10) -> DataFrame:
        """(a, b, sim, rank): the `top` best of the nearest `lists` lists. Approximate: what lies in other lists is not seen."""
        met = self._meet(self._visits(units(queries), None, False, lists), -2.0, 4.0, False)
        w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _copies(u: DataFrame) -> DataFrame:
    """The least id of every distinct vector of a block."""
    return u.groupBy("block", "unit").agg(F.min("id").alias("id")).select("id", "block", "unit")
