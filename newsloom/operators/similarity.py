"""Embeddings, blocked similarity joins, centroids, story clustering and threshold calibration."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text as X
from newsloom.operators.dedup import first_of
from newsloom.operators.stories import latest_published
from newsloom.operators.vector_index import VectorIndex
from newsloom.sources import shared

_TOKEN = re.compile(r"\w+")


class _Places(dict):
    """Numbers of words met, looked up without a call for a known one; `at` and `weight` hold each one's place and signed weight. A word of less than three letters weighs nothing."""

    MOST, PART = 200_000, 100_000

    def __init__(self, dim: int):
        self.dim, self.all = dim, np.arange(dim)
        self.at, self.weight = np.zeros(self.MOST + self.PART, dtype=np.int64), np.zeros(self.MOST + self.PART)

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        if len(token) >= 3:
            h = hashlib.blake2b(token.encode(), digest_size=8).digest()
            self.at[n], self.weight[n] = int.from_bytes(h[:4], "big") % self.dim, (1.0 if h[4] & 1 else -1.0) * (1 + math.log(len(token)))
        return n

    def add(self, v: np.ndarray, tokens: list[str]) -> np.ndarray:
        """The sums after these words, added one by one in their order. Long texts go in parts, so that the known words stay few."""
        for k in range(0, len(tokens), self.PART):
            rows = np.fromiter(map(self.__getitem__, tokens[k : k + self.PART]), dtype=np.int64)
            v = np.bincount(np.concatenate([self.all, self.at[rows]]), np.concatenate([v, self.weight[rows]]), self.dim)
            if len(self) > self.MOST:
                self.clear()
                self.at[:], self.weight[:] = 0, 0
        return v


def hash_embedding(texts: DataFrame, text: str = "text", dim: int = 1024) -> DataFrame:
    """Adds `embedding`: signed hashed words weighted by length, of norm one; all zero without a word of three letters."""

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def embed(column: pd.Series) -> pd.Series:
        places = _Places(dim)
        out = []
        for t in column:
            v = places.add(np.zeros(dim), _TOKEN.findall((t or "").casefold()))
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        return pd.Series(out)

    return texts.withColumn("embedding", embed(F.col(text)))


def check_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """Fails on a vector of another length."""
    wrong = F.raise_error(F.concat(F.lit("a vector has dimension "), F.size("embedding")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong))


def bands_for(threshold: float, bits: int, recall: float) -> int:
    """Bands of `bits` signs that meet a pair at the threshold with probability `recall`; closer pairs meet more often."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def sign_buckets(vectors: DataFrame, bands: int = 12, bits: int = 8, dim: int = 64, seed: int = 3) -> DataFrame:
    """(band, bucket) rows of a vector from signs of seeded random projections: the key of blocked similarity joins."""
    planes = np.random.default_rng(seed).normal(size=(bands * bits, dim)).astype(np.float32)

    @F.pandas_udf("array<int>")
    def keys(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        signs = (np.stack(column.to_list()) @ planes.T > 0).reshape(len(column), bands, bits)
        return pd.Series(list((signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)))

    return vectors.select("*", F.posexplode(keys("embedding")).alias("band", "bucket"))


def exact_pairs(vectors: DataFrame, threshold: float, hours: float | None = None, chunk: int | None = None) -> DataFrame:
    """As `similar_pairs`, and no pair is lost: the rows of a block lie in tiles of `chunk` rows and a time slot, which a task holds while earlier ones of the window stream past.

    A row is sent once to its tile and once to each tile that it streams past: those of its window, which are two while a window's rows fit one tile.
    """
    span = int(60 * hours) if hours is not None else None
    wide = dict(vectors.dtypes)["embedding"] != "array<float>"
    rows = vectors.select("id", "block", (F.col("pub_min").cast("bigint") if span is not None else F.lit(0)).cast("double").alias("at"), "embedding")
    # Told of the bytes: a filter on the vectors would make costly ones once more.
    rows = _as_bytes(rows.where("at IS NOT NULL"), ["id", "block", "at"]).where("embedding IS NOT NULL").withColumn("uid", F.monotonically_increasing_id())
    rows = shared.stored(rows.withColumn("part", F.xxhash64(F.isnull("block"), "block")), "vectors")
    met = _dealt(rows, None if span is None else max(span, 1), ["id", "block"], chunk or PAIR_TILE, carried=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _stream_past(batches, lambda: _PairTile(span, threshold, wide))

    return met.mapInArrow(task, "a long, b long, sim double").where("a < b")


def similar_pairs(vectors: DataFrame, threshold: float, hours: float | None = None, recall: float = 0.99, **lsh) -> DataFrame:
    """(a, b, sim) with a < b, of rows (id, embedding, block, and pub_min if `hours` is given) whose cosine reaches the threshold.

    Rows meet by band and bucket inside a block and, with `hours`, by time window (a row stands in its own window and the next one).
    There are enough bands to meet a pair at the threshold with probability `recall`, unless `bands` says otherwise; `exact_pairs`
    loses none. Rows without a block are a block of their own.
    """
    lsh["bands"] = lsh.get("bands") or bands_for(threshold, lsh.get("bits", 8), recall)
    keyed = sign_buckets(vectors.withColumn("block", F.coalesce(F.col("block").cast("string"), F.lit("\x00"))), **lsh)
    keys = ["block", "band", "bucket"]
    left, right = keyed, keyed
    if hours is not None:
        span = int(60 * hours)
        slot = F.floor(F.col("pub_min") / span)
        left = left.withColumn("slot", slot)
        right = right.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
        keys.append("slot")
    else:
        left, right = left.withColumn("pub_min", F.lit(0)), right.withColumn("pub_min", F.lit(0))
    a = left.select(F.col("id").alias("a"), F.col("embedding").alias("ea"), F.col("pub_min").alias("ta"), *keys)
    b = right.select(F.col("id").alias("b"), F.col("embedding").alias("eb"), F.col("pub_min").alias("tb"), *keys)
    met = a.join(b, keys).where(F.col("a") < F.col("b"))
    if hours is not None:
        met = met.where(F.abs(F.col("ta") - F.col("tb")) <= 60 * hours)
    met = met.withColumn("sim", X.cosine(F.col("ea"), F.col("eb"))).where(F.col("sim") >= threshold)
    return met.groupBy("a", "b").agg(F.first("sim").alias("sim"))


def border_pairs(pairs: DataFrame, labelled: DataFrame, threshold: float, band: float) -> DataFrame:
    """Pairs of different outlets (a, b, sim, source_a, source_b) near the threshold that nobody has labelled."""
    known = labelled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = pairs.where((F.abs(F.col("sim") - threshold) <= band) & (F.col("source_a") != F.col("source_b")))
    return near.join(known, ["a", "b"], "left_anti")


def centroids(vectors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Element-wise means by key: one partial sum a task and key, then the sums of those."""
    width = "array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for k, v in zip(pdf[key], pdf["embedding"]):
                s, n = sums.get(k, (0.0, 0))
                sums[k] = (s + np.asarray(v, dtype=np.float64), n + 1)
            if len(sums) > 50_000:
                yield pd.DataFrame({key: list(sums), "s": [s for s, _ in sums.values()], "n": [n for _, n in sums.values()]})
                sums = {}
        if sums:
            yield pd.DataFrame({key: list(sums), "s": [s for s, _ in sums.values()], "n": [n for _, n in sums.values()]})

    kind = dict(vectors.dtypes)[key]
    parts = vectors.select(key, "embedding").mapInPandas(partial, f"{key} {kind}, s {width}, n long")
    by_place = parts.select(key, "n", F.posexplode("s").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = by_place.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("m")))).alias("c"), F.max("n").alias("n"))
    return rows.select(key, F.transform("c", lambda x: x["m"]).alias("centroid"), "n")


def nearest_centroid(articles: DataFrame, open_stories: DataFrame, threshold: float, window_hours: int = 48, lists: int | None = None) -> DataFrame:
    """(id, cluster_id, sim): the most similar open story whose times lie within the window; ties go to the least story.

    The stories are indexed, and each article sees those at the threshold or more; equal centroids are searched once.
    """
    s = open_stories.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding"), F.lit("").alias("block"))
    index = VectorIndex.build(s, shared.folder(articles.sparkSession, "stories"), lists)
    times = index.members.select("id", F.col("rep").alias("b")).join(open_stories.select(F.col("cluster_id").alias("id"), "first_min", "last_min"), "id")
    met = index.within(articles.select("id", "embedding", F.lit("").alias("block")), threshold)
    met = met.join(times.withColumnRenamed("id", "cluster_id"), "b").join(articles.select(F.col("id").alias("a"), "pub_min"), "a")
    span = 60 * window_hours
    met = met.where((F.col("last_min") >= F.col("pub_min") - span) & (F.col("first_min") <= F.col("pub_min") + span))
    return first_of(met, ["a"], [F.desc("sim"), "cluster_id"]).select(F.col("a").alias("id"), "cluster_id", "sim")


class LeaderFold:
    """Stories of one block, built in time order: an article joins the nearest open story or opens one.

    Articles come in runs. The products of a run with the open stories and with itself are two matrix products; from then
    on a story's products and its length follow from those of what joins it, so an article costs a row of numbers, not of vectors.
    """

    def __init__(self, threshold: float, window_min: float, bound_first: bool):
        self.threshold, self.window, self.bound_first = threshold, window_min, bound_first
        self.sums = np.zeros((0, 0))
        self.first, self.last, self.lead = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)

    def put(self, leads: np.ndarray, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Take over stories of an earlier run."""
        self._append(sums, first, last, leads)

    def _append(self, sums, first, last, leads) -> None:
        self.sums = np.concatenate([self.sums, sums]) if len(self.sums) else np.array(sums, dtype=np.float64)
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])
        self.lead = np.concatenate([self.lead, np.asarray(leads, dtype=np.int64)])

    def add(self, keys: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The stories of a run of articles, sorted by time."""
        live = self.last >= at[0] - self.window  # what is idle now stays idle
        if not live.all():
            self.sums, self.first, self.last, self.lead = self.sums[live], self.first[live], self.last[live], self.lead[live]
        n, b = len(self.lead), len(v)
        room = n + b
        dots, within = np.empty((b, room)), v @ v.T
        dots[:, :n] = v @ self.sums.T if n else 0
        own = np.sqrt(within.diagonal())
        own = np.where(own > 0, own, 1.0)
        square = np.zeros(room)
        square[:n] = np.einsum("ij,ij->i", self.sums, self.sums) if n else 0
        length = np.ones(room)
        length[:n] = np.where(square[:n] > 0, np.sqrt(square[:n]), 1.0)
        grow = lambda x: np.concatenate([x, np.zeros(b, dtype=x.dtype)])
        first, last, lead, joined, m = grow(self.first), grow(self.last), grow(self.lead), np.empty(b, dtype=np.int64), n
        for i in range(b):
            j = -1
            if m:
                near = last[:m] >= at[i] - self.window
                if self.bound_first:
                    near &= first[:m] <= at[i] + self.window
                sim = np.where(near, dots[i, :m] / length[:m], -2 * own[i])
                j = int(sim.argmax())
                if not near[j] or sim[j] / own[i] < self.threshold:
                    j = -1
            if j < 0:
                j, m = m, m + 1
                dots[:, j], square[j] = within[:, i], within[i, i]
                first[j] = last[j] = at[i]
                lead[j] = keys[i]
            else:
                square[j] += 2 * dots[i, j] + within[i, i]
                dots[:, j] += within[:, i]
                first[j], last[j] = min(first[j], at[i]), max(last[j], at[i])
            length[j] = np.sqrt(square[j]) if square[j] > 0 else 1.0
            joined[i] = j
        sums = np.zeros((m, v.shape[1]))
        sums[:n] = self.sums if n else 0
        np.add.at(sums, joined, v)
        self.sums, self.first, self.last, self.lead = sums, first[:m], last[:m], lead[:m]
        return lead[joined]


#: Articles of a run.
RUN = 256
#: Nearest earlier articles that an article knows; a longer list costs space, a shorter one more looks at all stories. No result depends on it.
NEAR = 64
#: Articles of a tile, which a task holds while the earlier ones stream past it.
TILE = 16_384
#: Rows of a tile of `exact_pairs`: 64 MB of 256 floats. A longer one sends a row to fewer tiles and takes more of a task's memory.
PAIR_TILE = 65_536
#: More than single precision can be wrong by in a cosine.
SLACK = 1e-4


class NearFold:
    """As `LeaderFold`, where each article knows its nearest earlier articles, so that stories of one article cost nothing to compare with.

    Most stories never grow, and the product with one of them is the product of two articles, which `nearest_before` tells
    ahead and in parallel. Only stories that have grown are multiplied here. Where a cut list of nearest articles leaves it open whether
    another lone one is nearer, all lone ones are looked at.
    """

    def __init__(self, threshold: float, window_min: float, bound_first: bool, near: int = NEAR):
        self.threshold, self.window, self.bound_first, self.near = threshold, window_min, bound_first, near
        self.sums, self.pool = np.zeros((0, 0)), np.zeros((0, 0))
        self.first, self.last = np.zeros(0), np.zeros(0)
        self.lead, self.order = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.lone: dict[int, tuple] = {}  # uid -> (order, time, id, place in the pool), oldest first
        self.uid, self.when, self.size, self.alive = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), np.zeros(0, dtype=bool)
        self.used, self.opened = 0, 0

    def put(self, leads: np.ndarray, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Take over stories of an earlier run."""
        order = np.arange(self.opened, self.opened + len(leads))
        self.sums = np.concatenate([self.sums, sums]) if len(self.sums) else np.array(sums, dtype=np.float64)
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])
        self.lead, self.order = np.concatenate([self.lead, np.asarray(leads, dtype=np.int64)]), np.concatenate([self.order, order])
        self.opened += len(leads)

    def _forget(self, since: float) -> None:
        """What is idle now stays idle."""
        live = self.last >= since
        if not live.all():
            self.sums, self.first, self.last = self.sums[live], self.first[live], self.last[live]
            self.lead, self.order = self.lead[live], self.order[live]
        while self.lone and (uid := next(iter(self.lone))) is not None and self.lone[uid][1] < since:
            self.alive[self.lone.pop(uid)[3]] = False

    def _keep(self, uid: int, at: float, v: np.ndarray, length: float) -> int:
        """A place for a lone article; places are in the order of opening."""
        if self.used == len(self.pool):
            held = np.flatnonzero(self.alive[: self.used])
            size, n = max(1024, 2 * len(held)), len(held)
            for name in ("pool", "uid", "when", "size", "alive"):
                old = getattr(self, name)
                new = np.zeros((size, len(v)) if name == "pool" else size, dtype=old.dtype)
                if n:
                    new[:n] = old[held]
                setattr(self, name, new)
            self.lone = {u: (o, t, k, place) for place, (u, (o, t, k, _)) in enumerate(self.lone.items())}
            self.used = n
        k = self.used
        self.pool[k], self.uid[k], self.when[k], self.size[k], self.alive[k] = v, uid, at, length, True
        self.used += 1
        return k

    def _look(self, v: np.ndarray, since: float) -> tuple[int | None, float]:
        """The nearest of all lone articles."""
        if not self.used:
            return None, -np.inf
        some = self.alive[: self.used] & (self.when[: self.used] >= since)
        sim = np.where(some, self.pool[: self.used] @ v / self.size[: self.used], -np.inf)
        best = int(sim.argmax())  # the first of equals is the oldest
        return (int(self.uid[best]), float(sim[best])) if some[best] else (None, -np.inf)

    def add(self, uids: list, keys: np.ndarray, at: np.ndarray, v: np.ndarray, near: list, sims: list) -> np.ndarray:
        """The stories of a run of articles, sorted by time; `near` and `sims` are the uids of nearest earlier articles and the products over their lengths."""
        self._forget(at[0] - self.window)
        n, b = len(self.lead), len(v)
        room = n + b
        dots, within = np.empty((b, room)), v @ v.T
        dots[:, :n] = v @ self.sums.T if n else 0
        own = np.sqrt(within.diagonal())
        own = np.where(own > 0, own, 1.0)
        square = np.zeros(room)
        square[:n] = np.einsum("ij,ij->i", self.sums, self.sums) if n else 0
        length = np.ones(room)
        length[:n] = np.where(square[:n] > 0, np.sqrt(square[:n]), 1.0)
        grow = lambda x: np.concatenate([x, np.zeros(b, dtype=x.dtype)])
        first, last, lead, order, m = grow(self.first), grow(self.last), grow(self.lead), grow(self.order), n
        sums = np.zeros((room, v.shape[1]))
        sums[:n] = self.sums if n else 0
        lone, stories, joined = self.lone, np.empty(b, dtype=np.int64), np.full(b, -1)
        for i in range(b):
            since, j, best = at[i] - self.window, -1, -np.inf
            if m:
                open_ = last[:m] >= since
                if self.bound_first:
                    open_ &= first[:m] <= at[i] + self.window
                sim = np.where(open_, dots[i, :m] / length[:m], -np.inf)
                j = int(sim.argmax())
                best = sim[j]
                if m > n:  # stories that grew in this run do not stand in the order they were opened
                    same = np.flatnonzero(sim == best)
                    j = int(same[order[same].argmin()])
            u, s = None, -np.inf
            for x, y in zip(near[i], sims[i]):
                if u is not None and y < s:
                    break
                if (e := lone.get(x)) is not None and e[1] >= since and (u is None or e[0] < lone[u][0]):
                    u, s = x, y
            if len(near[i]) == self.near:
                most = sims[i][-1] + SLACK * own[i]
                if s < most and most >= best and most / own[i] >= self.threshold:
                    u, s = self._look(v[i], since)
            if u is not None and (s > best or (s == best and lone[u][0] < order[j])):
                if s / own[i] >= self.threshold:
                    o, t, k, place = lone.pop(u)
                    self.alive[place] = False
                    j, m = m, m + 1
                    sums[j] = self.pool[place]
                    product = v @ sums[j]
                    dots[:, j] = product
                    square[j] = sums[j] @ sums[j]
                    first[j] = last[j] = t
                    lead[j], order[j] = k, o
                else:
                    j = -1
            elif best / own[i] < self.threshold or best == -np.inf:
                j = -1
            if j < 0:
                place = self._keep(uids[i], at[i], v[i], own[i])  # may deal the places anew
                lone = self.lone
                lone[uids[i]] = (self.opened, at[i], keys[i], place)
                self.opened += 1
                stories[i] = keys[i]
            else:
                square[j] += 2 * dots[i, j] + within[i, i]
                dots[:, j] += within[:, i]
                first[j], last[j] = min(first[j], at[i]), max(last[j], at[i])
                length[j] = np.sqrt(square[j]) if square[j] > 0 else 1.0
                stories[i], joined[i] = lead[j], j
        some = joined >= 0
        np.add.at(sums, joined[some], v[some])
        self.sums, self.first, self.last, self.lead, self.order = sums[:m], first[:m], last[:m], lead[:m], order[:m]
        return stories


def _vectors(column: pa.Array, wide: bool) -> np.ndarray:
    """Vectors kept as bytes, a row each."""
    if not len(column):
        return np.zeros((0, 0))
    v = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64 if wide else np.float32)
    return v.reshape(len(column), -1)


def _as_bytes(rows: DataFrame, names: list[str]) -> DataFrame:
    """(names, embedding): the embedding's floats or doubles as bytes."""
    wide = not dict(rows.dtypes)["embedding"] == "array<float>"
    kept = rows.select(*names, F.col("embedding").cast("array<double>") if wide else F.col("embedding"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if x.values is None else np.asarray(x.values, dtype=np.float64 if wide else np.float32).tobytes() for x in batch.column(len(names))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*names, "embedding"])

    return kept.mapInArrow(packed, T.StructType([*kept.schema.fields[:-1], T.StructField("embedding", T.BinaryType())]))


class _Tile:
    """Articles of a tile, and the nearest of what streamed past them."""

    def __init__(self, window: float, least: float, wide: bool, fields: list[str], near: int = NEAR):
        self.window, self.least, self.wide, self.fields, self.near, self.batches, self.x = window, least, wide, fields, near, [], None

    def close(self) -> None:
        self.rows = pa.Table.from_batches(self.batches).combine_chunks()
        self.uid, self.at = self.rows["uid"].to_numpy(), self.rows["at"].to_numpy()
        self.v = _vectors(self.rows["embedding"].combine_chunks(), self.wide)
        norm = np.linalg.norm(self.v.astype(np.float64), axis=1)
        self.x = np.divide(self.v, norm[:, None], out=np.zeros(self.v.shape), where=norm[:, None] > 0).astype(np.float32)
        self.sim = np.full((len(self.x), self.near), -2, dtype=np.float32)
        self.who, self.s = np.full((len(self.x), self.near), -1), np.full((len(self.x), self.near), -np.inf)

    def past(self, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.meet(piece["uid"].to_numpy(), piece["at"].to_numpy(), _vectors(piece["embedding"], self.wide))
        return iter(())

    def meet(self, uid: np.ndarray, at: np.ndarray, w: np.ndarray, strip: int = 2048) -> None:
        """Earlier articles, by time, as they come."""
        norm = np.linalg.norm(w.astype(np.float64), axis=1)
        y = np.divide(w, norm[:, None], out=np.zeros(w.shape), where=norm[:, None] > 0).astype(np.float32)
        for c in range(0, len(y), strip):
            q, when = slice(c, c + strip), at[c : c + strip]
            for k in range(0, len(self.x), strip):
                p = slice(k, min(k + strip, len(self.x)))
                if when[0] > self.at[p][-1] or when[-1] < self.at[k] - self.window:
                    continue
                product = self.x[p] @ y[q].T
                floor = np.maximum(self.sim[p, -1], np.float32(self.least - SLACK / 2))
                hit = product > floor[:, None]
                if when[-1] >= self.at[k] or when[0] < self.at[p][-1] - self.window:
                    hit &= (when[None, :] <= self.at[p][:, None]) & (when[None, :] >= self.at[p][:, None] - self.window) & (uid[q][None, :] != self.uid[p][:, None])
                found = np.count_nonzero(hit, axis=1)
                many = np.flatnonzero(found > self.near)
                if len(many):
                    least = np.partition(np.where(hit[many], product[many], np.float32(-2)), -self.near, axis=1)[:, -self.near]
                    hit[many] &= product[many] >= least[:, None]
                some = np.flatnonzero(found)
                if not len(some):
                    continue
                r, column = np.nonzero(hit[some])
                value = product[some[r], column]
                order = np.lexsort((column, -value, r))
                r, column, value = r[order], column[order], value[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                r, column, value, nth = (x[nth < self.near] for x in (r, column, value, nth))
                fresh, top = np.full((len(some), self.near), -2, dtype=np.float32), np.zeros((len(some), self.near), dtype=np.int64)
                fresh[r, nth], top[r, nth] = value, column
                rows = k + some
                sim = np.concatenate([self.sim[rows], fresh], axis=1)
                who = np.concatenate([self.who[rows], np.where(fresh > -2, uid[q][top], -1)], axis=1)
                s = np.concatenate([self.s[rows], np.full(fresh.shape, -np.inf)], axis=1)
                order = np.argsort(-sim, axis=1, kind="stable")[:, :self.near]
                self.sim[rows], self.who[rows] = np.take_along_axis(sim, order, axis=1), np.take_along_axis(who, order, axis=1)
                kept = np.take_along_axis(s, order, axis=1)
                # Chosen in single precision; what stays is told in double.
                own, col = np.nonzero((order >= self.near) & (self.who[rows] >= 0))
                x, y_ = rows[own], c + top[own, order[own, col] - self.near]
                for e in range(0, len(x), 8192):
                    f = slice(e, e + 8192)
                    kept[own[f], col[f]] = np.einsum("ij,ij->i", self.v[x[f]].astype(np.float64), w[y_[f]].astype(np.float64)) / np.where(norm[y_[f]] > 0, norm[y_[f]], 1.0)
                self.s[rows] = kept

    def told(self) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-self.s, axis=1, kind="stable")
        who, s = np.take_along_axis(self.who, order, axis=1), np.take_along_axis(self.s, order, axis=1)
        given = who >= 0
        edges = np.concatenate([[0], np.cumsum(given.sum(axis=1))]).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(edges), pa.array(who[given]))
        sims = pa.ListArray.from_arrays(pa.array(edges), pa.array(s[given]))
        for k in range(0, len(self.x), 4096):
            part = self.rows.slice(k, 4096).combine_chunks()
            columns = [part[f].combine_chunks() if isinstance(part[f], pa.ChunkedArray) else part[f] for f in self.fields]
            yield pa.RecordBatch.from_arrays([*columns, near.slice(k, 4096), sims.slice(k, 4096)], names=[*self.fields, "near", "sims"])


class _PairTile:
    """Rows of a tile; pairs leave as what streams past meets them, so that only the tile and a batch are held."""

    def __init__(self, span: float | None, threshold: float, wide: bool):
        self.span, self.threshold, self.wide, self.batches, self.x = span, threshold, wide, [], None

    def _read(self, rows) -> tuple:
        v = _vectors(rows["embedding"].combine_chunks() if isinstance(rows, pa.Table) else rows["embedding"], self.wide)
        norm = np.concatenate([np.linalg.norm(v[k : k + 4096].astype(np.float64), axis=1) for k in range(0, len(v), 4096)]) if len(v) else np.zeros(0)
        unit = v / np.where(norm > 0, norm, 1)[:, None].astype(v.dtype)
        return rows["uid"].to_numpy(), rows["id"].to_numpy(), rows["block"].to_pylist(), rows["at"].to_numpy(), v, norm, unit.astype(np.float32)

    def close(self) -> None:
        table = pa.Table.from_batches(self.batches)
        self.batches = [None]
        self.uid, self.id, self.block, self.at, self.v, self.norm, self.x = self._read(table)
        self.blocks = len(set(self.block)) > 1

    def told(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def past(self, piece: pa.RecordBatch, strip: int = 2048) -> Iterator[pa.RecordBatch]:
        uid, ids, block, at, w, norm, unit = self._read(piece)
        other = self.blocks or set(block) != set(self.block[:1])  # blocks of one hash
        for c in range(0, len(w), strip):
            q = slice(c, min(c + strip, len(w)))
            across = unit[q].T.copy()
            for k in range(0, len(self.x), strip):
                p = slice(k, min(k + strip, len(self.x)))
                if self.span is not None and (at[q.start] > self.at[p.stop - 1] or at[q.stop - 1] < self.at[k] - self.span):
                    continue
                i, j = np.nonzero(self.x[p] @ across >= np.float32(self.threshold - SLACK))
                i, j = i + k, j + c
                # A pair is told where its earlier row streams past; of rows of one time the one with the lesser uid is the earlier.
                ok = (at[j] < self.at[i]) | ((at[j] == self.at[i]) & (uid[j] < self.uid[i]))
                if self.span is not None:
                    ok &= self.at[i] - at[j] <= self.span
                i, j = i[ok], j[ok]
                if other and len(i):
                    same = np.fromiter((self.block[x] == block[y] for x, y in zip(i, j)), dtype=bool, count=len(i))
                    i, j = i[same], j[same]
                for e in range(0, len(i), 16_384):
                    a, b = i[e : e + 16_384], j[e : e + 16_384]
                    scale = self.norm[a] * norm[b]
                    sim = np.divide(np.einsum("ij,ij->i", self.v[a].astype(np.float64), w[b].astype(np.float64)), scale, out=np.zeros(len(a)), where=scale > 0)
                    hit = sim >= self.threshold
                    x, y = self.id[a[hit]], ids[b[hit]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim[hit])], names=["a", "b", "sim"])


def _dealt(rows: DataFrame, span: float | None, names: list[str], size: int, carried: bool = False) -> DataFrame:
    """Rows (part, at, uid, names, embedding) dealt to tiles: (part, slot, tile, side, at, uid, names, embedding), a tile's own rows first (side 0), then what streams past it (side 1), by time.

    A tile is a time slot of a part, or a share of it, of about `size` rows at most; past it go the rows of its own slot and of the slots before it
    that lie in the window `span`; without one a part is a slot. Names of what streams past are null, if not `carried`.
    """
    steps, width = 0, float("inf")
    if span is not None:
        most = rows.groupBy("part", F.floor(F.col("at") / span)).count().agg(F.max("count")).first()[0] or 1
        steps = min(64, -(-most // size))
        width = span / steps * (1 + 1e-9)
    slotted = rows.withColumn("slot", F.floor(F.col("at") / width))
    full = slotted.groupBy("part", "slot").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles")).where("tiles > 1")  # at most a row per `size` rows
    tiles = lambda df: df.join(F.broadcast(full), ["part", "slot"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = tiles(slotted).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")).withColumn("side", F.lit(0))
    past = tiles(slotted.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + steps))))
    past = past.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(1))
    kinds = dict(rows.dtypes)
    order = ["part", "slot", "tile", "side", "at", "uid"]
    also = names if carried else [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    met = mine.select(*order, *names, "embedding").unionByName(past.select(*order, *also, "embedding"))
    spark = rows.sparkSession
    # A fixed number is not merged by size: a tile's work is its products, not its bytes.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return met.repartition(parts, "part", "slot", "tile").sortWithinPartitions(*order)


def _stream_past(batches: Iterator[pa.RecordBatch], new) -> Iterator[pa.RecordBatch]:
    """What tiles tell: each takes its own rows and is closed, then meets what streams past it; a slot without rows of its own has no tile."""
    tile = now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            key, piece = tuple(keys[a][:3]), batch.slice(a, b - a)
            if key != now:
                if tile is not None and tile.batches:
                    if tile.x is None:
                        tile.close()
                    yield from tile.told()
                tile, now = new(), key
            if keys[a][3] == 0:
                tile.batches.append(piece)
            elif tile.batches:
                if tile.x is None:
                    tile.close()
                yield from tile.past(piece)
    if tile is not None and tile.batches:
        if tile.x is None:
            tile.close()
        yield from tile.told()


def nearest_before(articles: DataFrame, block: list[str], least: float, window_hours: float, extra: list[str] | None = None, near: int = NEAR) -> DataFrame:
    """(uid, id, pub_min, block columns, extra, embedding as bytes, near, sims): for each article its `near` nearest earlier ones.

    Earlier ones are of its block, no newer, and within the window; of those below the cosine `least` none is told. Articles lie in
    tiles of a block and time slot, which a task holds; those of the window stream past a tile, so a task's memory is a tile's.
    """
    span, extra = max(60.0 * window_hours, 1.0), extra or []
    names = ["id", "pub_min", *block, *extra]
    wide = dict(articles.dtypes)["embedding"] != "array<float>"
    rows = _as_bytes(articles.withColumn("pub_min", F.nanvl(F.col("pub_min").cast("double"), F.lit(None).cast("double"))), names)
    # Articles without a time meet each other only. What shares a hash with another block costs work, not correctness.
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("at", F.coalesce("pub_min", F.lit(0.0)))
    rows = shared.stored(rows.withColumn("part", F.xxhash64(F.isnull("pub_min"), *block)), "articles")
    fields = ["uid", *names, "embedding"]
    met = _dealt(rows, span, names, TILE)
    schema = T.StructType([T.StructField(f, rows.schema[f].dataType) for f in fields]).add("near", T.ArrayType(T.LongType())).add("sims", T.ArrayType(T.DoubleType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _stream_past(batches, lambda: _Tile(span if window_hours > 0 else 0.0, least, wide, fields, near))

    return met.mapInArrow(task, schema)


def _fold(batches: Iterator[pd.DataFrame], keys: list[str], wide: bool, state_of) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, stories) of sorted rows (keys, carried, uid, id, pub_min, last_min, embedding, near, sims), run by run."""
    now, state = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in [*keys, "carried"]:
            x = pdf[k]
            change[1:] |= ~((x[1:].to_numpy() == x[:-1].to_numpy()) | (x[1:].isna().to_numpy() & x[:-1].isna().to_numpy()))
        edges = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])
        for a, b in zip(edges[:-1], edges[1:]):
            for k in range(a, b, RUN):
                part = pdf.iloc[k : min(k + RUN, b)]
                key = tuple(None if pd.isna(part[x].iloc[0]) else part[x].iloc[0] for x in keys)
                if key != now:
                    now, state = key, state_of(part)
                v = np.stack([np.frombuffer(x, dtype=np.float64 if wide else np.float32) for x in part.embedding]).astype(np.float64)
                at = part.pub_min.astype(float).fillna(np.inf).to_numpy()
                if part.carried.iloc[0]:
                    state.put(part.id.to_numpy(), v, at, part.last_min.astype(float).to_numpy())
                else:
                    yield part, state.add(part.uid.tolist(), part.id.to_numpy(), at, v, [x.tolist() for x in part.near], [x.tolist() for x in part.sims])


def _sorted(rows: DataFrame, keys: list[str], stories: DataFrame | None) -> DataFrame:
    rows = rows.withColumn("last_min", F.lit(None).cast("double")).withColumn("carried", F.lit(False))
    if stories is not None:
        open_ = stories.where("status = 'open'")
        summed = F.transform("centroid", lambda x: x.cast("double") * F.col("n"))
        names = ["id", "pub_min", "last_min", *keys]
        put = _as_bytes(open_.select(F.col("story").alias("id"), F.col("first_min").cast("double").alias("pub_min"), F.col("last_min").cast("double").alias("last_min"), summed.alias("embedding"), *keys), names)
        rows = rows.unionByName(put.withColumn("carried", F.lit(True)), allowMissingColumns=True)
    # Few long streams: many partitions, not merged by size, so that two of them seldom share a task.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("carried"), F.col("pub_min").asc_nulls_last(), "id", "uid")


def cluster(articles: DataFrame, threshold: float = 0.78, window_hours: float = 48, block: list[str] | None = None, bound_first: bool = True, stories: DataFrame | None = None, near: int = NEAR) -> DataFrame:
    """(id, story): leader clustering of (id, embedding, pub_min and the block columns), in time order inside a block.

    `stories` (story, centroid, n, first_min, last_min, status and the block columns) goes on from an earlier run: open ones
    take articles, closed ones never do. The products of articles are made in parallel (`nearest_before`). The order decides the result,
    so a block then is one sorted stream through one task; its state is the stories, not the articles. A story never spans two blocks.
    """
    keys = block or ["block"]
    if stories is not None:  # sums are doubles
        articles = articles.withColumn("embedding", F.col("embedding").cast("array<double>"))
    wide = dict(articles.dtypes)["embedding"] != "array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, story in _fold(batches, keys, wide, lambda _: NearFold(threshold, 60 * window_hours, bound_first, near)):
            yield part[["id", *keys]].assign(story=story)[["id", "story", *keys]]

    kinds = dict(articles.dtypes)
    schema = "id long, story long, " + ", ".join(f"{k} {kinds[k]}" for k in keys)
    return _sorted(nearest_before(articles, keys, threshold, window_hours, near=near), keys, stories).mapInPandas(run, schema)


def story_table(articles: DataFrame, clustered: DataFrame, as_of: int, keys: list[str], idle_hours: int = 36, before: DataFrame | None = None) -> DataFrame:
    """(story, centroid, n, first_min, last_min, status, keys) after a run; goes into the next one as `stories`. What is idle is closed and stays so."""
    rows = articles.join(clustered.select("id", "story"), "id").select("id", "story", "pub_min", "embedding", *keys)
    if before is not None:
        old = before.select(F.col("story"), "centroid", F.col("n").cast("long").alias("n"), F.col("first_min"), F.col("last_min"), "status", *keys)
    c = centroids(rows.select("story", "embedding"), "story")
    t = rows.groupBy("story", *keys).agg(F.min("pub_min").alias("first_min"), F.max("pub_min").alias("last_min"))
    new = t.join(c, "story").select("story", "centroid", "n", "first_min", "last_min", F.lit("open").alias("status"), *keys)
    if before is not None:
        o, w = old.alias("o"), new.alias("w")
        pick = lambda f, c: f(F.col(f"o.{c}"), F.col(f"w.{c}")).alias(c)
        n = F.coalesce("o.n", F.lit(0)) + F.coalesce("w.n", F.lit(0))
        mean = F.zip_with("o.centroid", "w.centroid", lambda x, y: (x * F.col("o.n") + y * F.col("w.n")) / (F.col("o.n") + F.col("w.n")))
        new = o.join(w, F.col("o.story") == F.col("w.story"), "full_outer").select(
            pick(F.coalesce, "story"), F.coalesce(mean, "o.centroid", "w.centroid").alias("centroid"), n.alias("n"), pick(F.least, "first_min"), pick(F.greatest, "last_min"), pick(F.coalesce, "status"), *[pick(F.coalesce, k) for k in keys]
        )
    return new.withColumn("status", F.when(F.col("last_min") < as_of - 60 * idle_hours, "closed").otherwise(F.col("status")))


def sweep(articles: DataFrame, thresholds: list[float], window_hours: float = 48, block: str = "block") -> DataFrame:
    """Cluster sizes' summary per threshold; thresholds and blocks run side by side and share the products of articles."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    wide, keys = dict(articles.dtypes)["embedding"] != "array<float>", ["threshold", block]
    rows = shared.stored(nearest_before(articles, [block], min(thresholds), window_hours, ["source_id"]), "nearest").withColumn("threshold", grid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, story in _fold(batches, keys, wide, lambda part: NearFold(part.threshold.iloc[0], 60 * window_hours, False)):
            yield part[["source_id", *keys]].assign(story=story)[["threshold", block, "story", "source_id"]]

    kinds = dict(articles.dtypes)
    stories = _sorted(rows, keys, None).mapInPandas(run, f"threshold double, {block} {kinds[block]}, story long, source_id {kinds['source_id']}")
    return summarise(stories, ["threshold"], [block, "story"])


def summarise(stories: DataFrame, by: list[str], story: list[str]) -> DataFrame:
    """Per group: stories, singletons, the largest, the five largest, upper median size, stories of three outlets."""
    s = stories.groupBy(*by, *story).agg(F.count("*").alias("size"), F.count_distinct("source_id").alias("outlets"))
    w = Window.partitionBy(*by).orderBy(F.desc("size"), *story)
    n = F.count("*").over(Window.partitionBy(*by))
    r = s.withColumn("rn", F.row_number().over(w)).withColumn("n", n)
    return r.groupBy(*by).agg(
        F.count("*").alias("clusters"),
        F.count_if(F.col("size") == 1).alias("singletons"),
        F.max("size").alias("top1"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.col("size"))))).alias("top5"),
        F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("size"))).alias("median"),
        F.count_if(F.col("outlets") >= 3).alias("eligible"),
    )


def recommend_threshold(labels: DataFrame, low: int = 30, high: int = 95) -> DataFrame:
    """One row from (same_story, sim): the middle of the best plateau on a grid of hundredths, its accuracy, and whether the classes overlap."""
    cents = F.floor(F.round(F.col("sim") * 10000) / 100)  # whole hundredths that sim reaches
    counts = labels.groupBy(F.greatest(F.lit(low - 1), F.least(F.lit(high), cents)).cast("int").alias("c")).agg(F.count_if("same_story").alias("s"), F.count_if(~F.col("same_story")).alias("d"))
    grid = labels.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("c"))
    one = Window.partitionBy(F.lit(1)).orderBy("c")  # at most a row per hundredth
    g = grid.join(counts, "c", "left").fillna(0, ["s", "d"])
    g = g.withColumn("below_d", F.coalesce(F.sum("d").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = g.withColumn("above_s", F.sum("s").over(one.rowsBetween(0, Window.unboundedFollowing))).where(F.col("c") >= low)
    best = g.withColumn("hits", F.col("below_d") + F.col("above_s")).withColumn("top", F.max("hits").over(Window.partitionBy(F.lit(1)))).where("hits = top")
    place = best.withColumn("rn", F.row_number().over(one)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1)))).where(F.col("rn") == F.floor(F.col("n") / 2) + 1)
    facts = labels.agg(
        F.count("*").alias("n_labels"), F.count_if("same_story").alias("n_same"), F.count_if(~F.col("same_story")).alias("n_diff"),
        F.min(F.when(F.col("same_story"), F.col("sim"))).alias("same_min"), F.max(F.when(~F.col("same_story"), F.col("sim"))).alias("diff_max"),
    )
    both = (F.col("n_same") > 0) & (F.col("n_diff") > 0)
    return facts.crossJoin(place.select("c", "hits")).select(  # two single rows
        F.when(both, F.col("c") / 100).alias("threshold"), F.when(both, F.round(F.col("hits") / F.col("n_labels"), 3)).alias("accuracy"), "n_labels", "n_same", "n_diff", (F.col("same_min") <= F.col("diff_max")).alias("overlap")
    )


def related_stories(stories: DataFrame, posts: DataFrame, blocked: DataFrame, as_of: int, threshold: float = 0.70, days: int = 120, top: int = 5, lists: int | None = None) -> DataFrame:
    """(cluster_id, related_id, sim, rank): the `top` nearest stories among those with a live post that no block forbids.

    `stories` has (cluster_id, centroid); a live post is the latest published one with a message, and may be `days` old.
    """
    live = latest_published(posts).where(F.col("pub_min") >= as_of - 1440 * days).select("cluster_id")
    rows = stories.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding"), F.lit("").alias("block"))
    index = VectorIndex.build(rows.join(live.withColumnRenamed("cluster_id", "id"), "id", "left_semi"), shared.folder(stories.sparkSession, "posted"), lists)
    met = index.within(rows, threshold).join(index.members.select(F.col("id").alias("related_id"), F.col("rep").alias("b")), "b")
    met = met.select(F.col("a").alias("cluster_id"), "related_id", "sim").where("cluster_id <> related_id")
    pair = blocked.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct()
    met = met.join(pair, (F.least("cluster_id", "related_id") == F.col("_x")) & (F.greatest("cluster_id", "related_id") == F.col("_y")), "left_anti")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("sim"), "related_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def pick_related(related: DataFrame, posts: DataFrame) -> DataFrame:
    """(cluster_id, related_id, why): of the nearest stories the first that shares the topic or an entity with it; posts has (cluster_id, topic, entity_ids), one a story."""
    me = posts.select("cluster_id", F.col("topic").alias("_t"), F.col("entity_ids").alias("_e"))
    other = posts.select(F.col("cluster_id").alias("related_id"), "topic", "entity_ids")
    j = related.join(other, "related_id").join(me, "cluster_id", "left")
    same = F.coalesce(F.col("topic") == F.col("_t"), F.lit(False))
    shared = F.coalesce(F.arrays_overlap("entity_ids", "_e"), F.lit(False))
    w = Window.partitionBy("cluster_id").orderBy("rank")
    hit = j.where(same | shared).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return hit.select("cluster_id", "related_id", F.when(same, "topic").otherwise("entity").alias("why"))
