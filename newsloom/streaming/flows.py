"""Structured Streaming forms of what a cron job would do: late data, deduplication, windows, sessions, story growth and state.

Inputs are streams with an event time `ts` (timestamp). Each function returns a streaming frame; `drain` runs
one to the end of its available input with a checkpoint, exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from newsloom.operators.similarity import RUN, LeaderFold


def fresh(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Rows later than the watermark are dropped by the stateful operators below it."""
    return stream.withWatermark("ts", f"{hours} hours")


def dedup(stream: DataFrame, keys: list[str], hours: int = 48) -> DataFrame:
    """The first row of every key within the watermark."""
    return fresh(stream, hours).dropDuplicatesWithinWatermark(keys)


def dedup_with_history(stream: DataFrame, keys: list[str], history: DataFrame, hours: int = 48) -> DataFrame:
    """As `dedup`, and without keys of a static table, which reach back further than the state."""
    return dedup(stream, keys, hours).join(history.select(*keys).distinct(), keys, "left_anti")


def velocity(stream: DataFrame, key: str = "cluster_id", hours: int = 6) -> DataFrame:
    """Articles per story in sliding windows of six hours."""
    return fresh(stream).groupBy(F.window("ts", f"{hours} hours", "1 hour"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class _Trailing(_Processor):
    """Waiting rows until the watermark has passed them, and the times of the last `span` microseconds before it."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trailing", "recent array<long>, times array<long>, ids array<long>")

    def _load(self) -> list[np.ndarray]:
        found = self.state.get() if self.state.exists() else ([], [], [])
        return [np.array(x, dtype=np.int64) for x in found]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        recent, times, ids = self._load()
        new = pd.concat(list(rows))
        times, ids = np.concatenate([times, new.us.to_numpy()]), np.concatenate([ids, new.id.to_numpy()])
        self.state.update((recent.tolist(), times.tolist(), ids.tolist()))
        self.handle_timer(times)
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "id": [], "n": []})

    def handle_timer(self, times: np.ndarray) -> None:
        if len(times):
            self.handle.registerTimer(int(times.min() // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs() * 1000
        recent, times, ids = self._load()
        done = times <= now
        all_ = np.sort(np.concatenate([recent, times[done]]))
        n = np.searchsorted(all_, times[done], side="right") - np.searchsorted(all_, times[done] - self.span, side="left")
        self.state.update((all_[all_ > now - self.span].tolist(), times[~done].tolist(), ids[~done].tolist()))
        self.handle_timer(times[~done])
        yield pd.DataFrame({"key": [key[0]] * int(done.sum()), "id": ids[done], "n": n})


def rolling_quota(stream: DataFrame, key: str = "channel", hours: int = 24) -> DataFrame:
    """(key, id, n): at every post (id, ts, key) how many of its key came in the `hours` up to it, itself included. Exact, in order of event time whatever the arrival."""
    rows = stream.withWatermark("ts", "1 hour").select(F.col(key).cast("string").alias("key"), "id", F.unix_micros("ts").alias("us"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(_Trailing(hours * 3_600_000_000), "key string, id long, n long", "Append", "EventTime")


def weekly_taps(stream: DataFrame) -> DataFrame:
    """Taps and about how many users a week; the sketch keeps the state small."""
    return fresh(stream, 24).groupBy(F.window("ts", "7 days")).agg(F.count("*").alias("taps"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "taps", "users")


def story_sessions(stream: DataFrame, key: str = "cluster_id", idle_hours: int = 36) -> DataFrame:
    """Stories as sessions: one ends when nothing came for `idle_hours`."""
    w = F.session_window("ts", f"{idle_hours} hours")
    return fresh(stream).groupBy(w, key).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select(key, F.col("session_window.start").alias("start"), "last_ts", "n")


#: Most rows of a pack, and rows that a task holds to pack.
PACK, HELD = 4096, 200_000


def _packed(rows: DataFrame, keys: int) -> DataFrame:
    """(keys, last, lists of the rest): rows (`keys` columns, us and more) of equal keys in packs, as they come; `last` is the latest time of a pack."""
    fields = rows.schema.fields

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            of = pd.DataFrame({k: t[k].to_pandas() for k in range(keys)}).groupby(list(range(keys)), sort=False)
            group = of.ngroup().to_numpy() * (t.num_rows // PACK + 1) + of.cumcount().to_numpy() // PACK
            t = t.take(pa.array(np.argsort(group, kind="stable")))
            edges = np.flatnonzero(np.diff(np.sort(group), prepend=-1))
            ends = pa.array(np.append(edges, t.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, t[k].combine_chunks()) for k in range(keys, t.num_columns)]
            last = np.maximum.reduceat(t["us"].to_numpy(), edges)
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(t[k].combine_chunks().take(pa.array(edges)) for k in range(keys)), pa.array(last), *lists], names=[*names[:keys], "last", *names[keys:]])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from made()
                held, n = [], 0
        if n:
            yield from made()

    out = T.StructType([*fields[:keys], T.StructField("last", T.LongType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields[keys:])])
    return rows.mapInArrow(pack, out)


def story_growth(posts: DataFrame, articles: DataFrame, hours: int = 48) -> DataFrame:
    """New owners' articles of a posted story within `hours` of the post; both sides forget what is older.

    The sides meet by story and time slot (an eighth of the hours), and on both sides what is of one slot stands in packs, so that the state
    holds a row a pack and not a row a post and slot. A pack is as late as its last row; rows are told exactly when packs have met.
    """
    slot_us = max(1, hours * 3_600_000_000 // 8)
    at = lambda c: F.floor(F.unix_micros(c) / slot_us).cast("long").alias("slot")
    p = posts.where("cluster_id IS NOT NULL AND post_ts IS NOT NULL").select("cluster_id", at(F.col("post_ts")), F.unix_micros("post_ts").alias("us"), "post_id", "posted_owners")
    p = _packed(p, 2).withColumn("last", F.timestamp_micros("last")).withWatermark("last", "1 hour")
    reach = -(-hours * 3_600_000_000 // slot_us)
    p = p.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.lit(reach).cast("long")))).alias("p")
    a = articles.where("cluster_id IS NOT NULL AND ts IS NOT NULL").select("cluster_id", at(F.col("ts")), F.unix_micros("ts").alias("us"), "owner")
    a = _packed(a, 2).withColumn("last", F.timestamp_micros("last")).withWatermark("last", f"{hours} hours").alias("a")
    # A pack's first row is less than a slot before its last one.
    near = F.expr(f"a.last > p.last - INTERVAL {slot_us} MICROSECONDS AND a.last <= p.last + INTERVAL {hours} HOURS + INTERVAL {slot_us} MICROSECONDS")
    met = p.join(a, (F.col("p.cluster_id") == F.col("a.cluster_id")) & (F.col("p.slot") == F.col("a.slot")) & near)
    packs = met.select("p.cluster_id", F.arrays_zip(F.col("a.owner").alias("owner"), F.col("a.us").alias("us")).alias("_articles"), F.arrays_zip(F.col("p.post_id").alias("post_id"), F.col("p.us").alias("post_us"), F.col("p.posted_owners").alias("posted_owners")).alias("_posts"))
    rows = packs.select("cluster_id", "_articles", F.inline("_posts")).select("cluster_id", "post_id", "post_us", "posted_owners", F.inline("_articles"))
    rows = rows.where(f"us > post_us AND us <= post_us + {hours * 3_600_000_000} AND NOT array_contains(posted_owners, owner)")
    return rows.select("post_id", "cluster_id", "owner", F.timestamp_micros("us").alias("ts"))


class _Promotion(_Processor):
    """Of the stories of a bucket: first time and outcome, and while that is open the first time of each owner."""

    def __init__(self, least: int, hours: int):
        self.least, self.span = least, hours * 3_600_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stories", "ids array<long>, first array<long>, done array<boolean>, of array<long>, owners array<string>, ms array<long>")

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        ids, first, done, of, owners, ms = self.state.get() if self.state.exists() else ([], [], [], [], [], [])
        stories = pd.DataFrame({"first": np.array(first, dtype=np.int64), "done": np.array(done, dtype=bool)}, index=np.array(ids, dtype=np.int64))
        return stories, pd.DataFrame({"id": np.array(of, dtype=np.int64), "owner": np.array(owners, dtype=object), "ms": np.array(ms, dtype=np.int64)})

    def _store(self, stories: pd.DataFrame, owners: pd.DataFrame) -> None:
        self.state.update((stories.index.tolist(), stories["first"].tolist(), stories.done.tolist(), owners.id.tolist(), owners.owner.tolist(), owners.ms.tolist()))
        waiting = stories["first"][~stories.done]
        if len(waiting):
            self.handle.registerTimer(int(waiting.min()) + self.span)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        stories, owners = self._load()
        new = pd.concat(list(rows)).rename(columns={"cluster_id": "id"})
        new["id"] = new.id.fillna(0).astype(np.int64)
        first = new.groupby("id").ms.min()
        at = stories.index.union(first.index)
        first = pd.concat([stories["first"], first]).groupby(level=0).min().reindex(at)
        stories = pd.DataFrame({"first": first.astype(np.int64), "done": stories.done.reindex(at, fill_value=False).astype(bool)})
        # Earlier rows may still come while the watermark is below, so the verdict waits for the timer.
        new = new[~stories.done.reindex(new.id).to_numpy()]
        self._store(stories, pd.concat([owners, new[["id", "owner", "ms"]]]).groupby(["id", "owner"], as_index=False).ms.min())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        stories, owners = self._load()
        due = ~stories.done & (stories["first"] + self.span <= timerValues.getCurrentWatermarkInMs())
        if due.any():
            soon = owners.id[owners.ms <= stories["first"].reindex(owners.id).to_numpy() + self.span].value_counts().reindex(due.index[due], fill_value=0)
            stories["done"] |= due
            self._store(stories, owners[~owners.id.isin(soon.index)])
            ids = soon.index.to_series() if key[0] >= 0 else pd.Series([None] * len(soon), dtype="Int64")
            yield pd.DataFrame({"cluster_id": ids.to_numpy(), "outcome": np.where(soon.to_numpy() >= self.least, "promoted", "expired")})


#: Buckets of stories; a bucket is a key of the state, since a key costs calls between Spark and Python.
BUCKETS = 1024


def promotion(stream: DataFrame, least_owners: int = 3, hours: int = 4) -> DataFrame:
    """(cluster_id, outcome) of a story (cluster_id, ts, owner), once: promoted if enough owners wrote within `hours` of the first article, else expired. An event-time timer gives the verdict when the watermark has passed."""
    bucket = F.when(F.col("cluster_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("cluster_id"), F.lit(BUCKETS))).cast("int")
    rows = stream.withWatermark("ts", "10 minutes").where("owner IS NOT NULL").select(bucket.alias("bucket"), "cluster_id", "ts", F.unix_millis("ts").alias("ms"), "owner")
    return rows.groupBy("bucket").transformWithStateInPandas(_Promotion(least_owners, hours), "cluster_id long, outcome string", "Append", "EventTime")


class _Stories(_Processor):
    """The open stories of a block as a map; a timer takes away each when it has been idle for the window."""

    def __init__(self, threshold: float, minutes: float):
        self.threshold, self.minutes = threshold, minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.stories = handle.getMapState("stories", "lead long", "first double, last double, sum binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        new = pd.concat(list(rows)).sort_values(["ts", "id"])
        at = new.ts.map(lambda t: t.timestamp() / 60).to_numpy()
        v = np.stack(new.embedding.to_list()).astype(np.float64)
        fold = LeaderFold(self.threshold, self.minutes, False)
        held = [(k[0], *x) for k, x in self.stories.iterator()]
        if held:
            fold.put(np.array([x[0] for x in held]), np.stack([np.frombuffer(x[3]) for x in held]), np.array([x[1] for x in held]), np.array([x[2] for x in held]))
        story = np.concatenate([fold.add(new.id.to_numpy()[k : k + RUN], at[k : k + RUN], v[k : k + RUN]) for k in range(0, len(v), RUN)])
        touched = set(story.tolist())
        for lead, first, last, total in zip(fold.lead.tolist(), fold.first.tolist(), fold.last.tolist(), fold.sums):
            if lead in touched:
                self.stories.updateValue((lead,), (first, last, total.tobytes()))
                self.handle.registerTimer(int((last + self.minutes) * 60_000) + 1)
        yield pd.DataFrame({"id": new.id.to_numpy(), "story": story})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs() / 60_000
        for lead in [k[0] for k, x in self.stories.iterator() if x[1] + self.minutes < now]:
            self.stories.removeKey((lead,))
        yield pd.DataFrame({"id": [], "story": []})


def cluster_stream(stream: DataFrame, threshold: float = 0.78, window_hours: int = 48) -> DataFrame:
    """(id, story): leader clustering of (block, id, ts, embedding) with its open stories in the stream's state, each under a key of its own.

    Micro-batches are taken as they come, rows of one in order of (ts, id); a story that was idle for the window goes by an event-time timer.
    """
    rows = stream.withWatermark("ts", "1 hour").select("block", "id", "ts", "embedding")
    return rows.groupBy("block").transformWithStateInPandas(_Stories(threshold, 60.0 * window_hours), "id long, story long", "Append", "EventTime")


_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run to the end of the available input into Parquet under `folder`; running again goes on from the checkpoint. State lies in RocksDB, as timers and maps need."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(_PROVIDER, before)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class KeyedTable:
    """A keyed table under a folder that takes upserts: rows lie in buckets of their keys, and a version says which batch wrote each bucket last.

    A batch writes the buckets that it touches and then, as its commit, the version's list of (bucket, batch), at most
    `buckets` rows. A batch that comes again after its commit changes nothing. Bucket files that the version before last
    alone named are removed.
    """

    def __init__(self, spark, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets

    def _version(self, number: int) -> dict[int, int]:
        path = f"{self.folder}/versions/{number}"
        if number < 0 or not _exists(self.spark, f"{path}/_SUCCESS"):
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.parquet(path).collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, where: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.folder}/data/{batch}/bucket={k}" for k, batch in where.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, number: int, merge) -> None:
        """merge(old, batch) gives the new rows of the touched buckets."""
        if self._version(number):
            return
        last = self._version(number - 1)
        batch = batch.persist()
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # at most `buckets`
        old = self._rows({k: last[k] for k in touched if k in last}, batch.schema)
        merge(old, batch).withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{number}")
        batch.unpersist()
        now = last | {k: number for k in touched}
        self.spark.createDataFrame(list(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{number}")
        gone = set(self._version(number - 2).items()) - set(last.items())
        for k, b in gone:
            _delete(self.spark, f"{self.folder}/data/{b}/bucket={k}")
        if number >= 2:
            _delete(self.spark, f"{self.folder}/versions/{number - 2}")

    def read(self, schema) -> DataFrame:
        """The table after the last committed batch."""
        path, done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions"), []
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(path):
            done = [int(x.getPath().getName()) for x in files.listStatus(path) if _exists(self.spark, f"{x.getPath()}/_SUCCESS")]
        return self._rows(self._version(max(done, default=-1)), schema)


def upsert_each_batch(stream: DataFrame, folder: str, keys: list[str], merge, buckets: int = 64) -> DataFrame:
    """Apply merge(old, batch) per micro-batch to a KeyedTable, exactly once; the table after the last batch."""
    table = KeyedTable(stream.sparkSession, folder, keys, buckets)
    write = lambda batch, number: table.upsert(batch, number, merge)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read(stream.schema)
