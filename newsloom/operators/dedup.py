"""Exact deduplication and keyed upserts, as pure plans over versions of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.sources import shared


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every key; Spark prunes the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def new_articles(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Arrivals that are neither a title repeat inside their outlet (checked first) nor a URL repeat, here or in `known`."""
    keyed = incoming.withColumn("title_hash", X.title_hash(F.col("title")))
    old = known.select("source_id", X.title_hash(F.col("title")).alias("title_hash")).distinct()
    fresh = first_of(keyed.join(old, ["source_id", "title_hash"], "left_anti"), ["source_id", "title_hash"], ["pub_min", "id"])
    fresh = fresh.join(known.select("url_canonical").distinct(), "url_canonical", "left_anti")
    return first_of(fresh, ["url_canonical"], ["pub_min", "id"])


def insert_absent(target: DataFrame, delta: DataFrame, keys: list, order: list) -> DataFrame:
    """Target plus the first row of every key that it lacks."""
    return target.unionByName(first_of(delta, keys, order).join(target.select(*keys), keys, "left_anti"))


def merge_upsert(base: DataFrame, delta: DataFrame, keys: list, policy: dict[str, str]) -> DataFrame:
    """Base after the upsert of a keyed delta. Policy per column: keep (old wins), take (new wins), add, greatest, least; keys must be unique on both sides."""
    b, d = base.alias("b"), delta.alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    joined = b.join(d, on, "full_outer")

    def merged(c: str):
        if c in keys:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"d.{c}")).alias(c)
        rule = policy.get(c, "keep")
        if c not in delta.columns:
            return F.col(f"b.{c}").alias(c)
        old, new = F.col(f"b.{c}"), F.col(f"d.{c}")
        made = {
            "keep": F.coalesce(old, new),
            "take": F.coalesce(new, old),
            "add": F.coalesce(old + new, old, new),
            "greatest": F.greatest(old, new),
            "least": F.least(old, new),
        }[rule]
        return made.alias(c)

    return joined.select(*map(merged, base.columns))


def link_edges(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Undirected edges (a < b) after new ones; blocked stays blocked, and blocking wins over related."""
    tidy = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").where("a <> b")
    both = tidy(edges).unionByName(tidy(delta))
    return both.groupBy("a", "b").agg(F.when(F.bool_or(F.col("kind") == "blocked"), "blocked").otherwise("related").alias("kind"))


def merge_entities(aliases: DataFrame, mentions: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases and mention counts after entities were merged by mapping (old_id, new_id)."""
    m = mapping.select(F.col("old_id").alias("entity_id"), "new_id")
    move = lambda t: t.join(m, "entity_id", "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("new_id")
    return move(aliases).distinct(), move(mentions).groupBy("entity_id").agg(F.sum("mentions").alias("mentions"))


def _window_hashes(df: DataFrame, key: str, mark: str, n: int, bits: np.ndarray | None = None) -> DataFrame:
    """(key, place, h): 64-bit hashes of windows of n words; with `bits`, only those whose bit is set, tested in the scan's stage."""
    words = df.select(key, F.transform(X.words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    kept = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = kept.value
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):  # the arrays below hold several words' worth a window
            lists = batch.column(1)
            h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = np.array(lists.value_lengths().fill_null(0).to_pylist(), dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - (n - 1), 0))
            count = np.maximum(sizes - (n - 1), 0)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = starts[row] + place
            made = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                made = (made ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                made ^= made >> np.uint64(29)
            if filter_ is not None:
                p = made & np.uint64(8 * len(filter_) - 1)
                hit = (filter_[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                row, place, made = row[hit], place[hit], made[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(made.view(np.int64))], names=[key, mark, "h"])

    return words.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {mark} int, h bigint")


def _bits(windows: DataFrame, log2: int) -> np.ndarray:
    """2 ** log2 bits, set at the hashes; partial bitmaps come from the tasks in runs of 4 KB."""
    p = F.col("h").bitwiseAND((1 << log2) - 1) + 1  # the functions below count from 1
    rows = windows.groupBy(F.bitmap_bucket_number(p).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("b"))
    out = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for k, b in rows.collect():  # 2 ** (log2 - 15) rows
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(b)] = np.frombuffer(bytes(b), dtype=np.uint8)
    return out


def shared_shingles(texts: DataFrame, sources: DataFrame, n: int = 10) -> DataFrame:
    """(id, source_id, shingle): the first common window of n words in sort order, of every text and source that share one.

    The sources' windows set bits in a filter of fixed size (about 16 bits a window, 16 MB at most). A text's windows are
    tested in the stage that scans it, so what is shuffled is near the number of hits; a fuller filter lets more through and loses
    nothing. Windows meet by hash and place alone; words are looked up again, and compared, only in texts that met one.
    """
    own = shared.stored(_window_hashes(shared.spread(sources), "source_id", "b", n), "windows")
    log2 = min(27, max(16, (16 * own.count()).bit_length()))
    found = shared.stored(_window_hashes(shared.spread(texts), "id", "a", n, _bits(own, log2)), "hits")

    def spelled(df: DataFrame, key: str, mark: str) -> DataFrame:
        ids = met.select(key).distinct()
        words = df.join(ids, key, "left_semi").select(key, X.words(F.col("text")).alias("w"))
        at = met.select(key, mark).distinct()
        return words.join(at, key).select(key, mark, F.array_join(F.slice("w", F.col(mark) + 1, n), " ").alias(f"{mark}_words"))

    met = shared.stored(found.join(own, "h").select("id", "source_id", "a", "b"), "met")
    both = met.join(spelled(texts, "id", "a"), ["id", "a"]).join(spelled(sources, "source_id", "b"), ["source_id", "b"])
    return both.where("a_words = b_words").groupBy("id", "source_id").agg(F.min("a_words").alias("shingle"))
