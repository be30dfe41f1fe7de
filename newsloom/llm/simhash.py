"""SimHash near-duplicates: fingerprints, a binary-trie self-join under an error budget, components.

The trie over all fingerprints is laid out as a forest. The 64 bits are cut into `blocks` equal
blocks; with at most `max_bits` differing bits at least `blocks - max_bits` of the blocks agree,
so for each choice of that many blocks there is one trie whose first levels are those blocks.
There the error budget is zero, so its upper part is a plain equality and Spark hash-partitions by
it; below, `trie_links` walks node pairs together, adds up differing bits and prunes a pair as soon
as its sum exceeds the budget. Only a spanning star of what is linked leaves a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import append_columns, by_ids, cut, free_name, spread_join
from newsloom.llm.graph import connected_components


def simhash(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        raw = digest(joined, 42)
    else:
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])])
    n = len(raw) // 8
    counts = np.zeros(64, dtype=np.int64)
    bits = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    for k in range(0, n, 65536):
        counts += np.unpackbits(bits[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> tuple[DataFrame, str]:
    """`docs` with a bigint column of the fingerprint's bits, and that column's name."""

    def kernel(texts: list) -> list:
        return [np.array([simhash(t, width) for t in texts], dtype=np.uint64).view(np.int64)]

    out, (name,) = append_columns(docs, text, [("fingerprint_bits", T.LongType())], kernel)
    return out, name


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _permuted(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The bits of `fp` (uint64), block by block in the given order, first block on top."""
    out, left = np.zeros_like(fp), 64
    for lo, hi in order:
        w = hi - lo
        left -= w
        out |= ((fp >> np.uint64(64 - hi)) & np.uint64((1 << w) - 1)) << np.uint64(left)
    return out


def _flatten(label: np.ndarray) -> np.ndarray:
    while True:
        nxt = label[label]
        if np.array_equal(nxt, label):
            return label
        label = nxt


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of the pairs (i, j); a label is the least position of its class."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        label = _flatten(label)
    return label


def trie_links(
    fp: np.ndarray, order: np.ndarray, start: np.ndarray, lo_hi: list, side: np.ndarray, max_bits: int, leaf: int = 64, chunk: int = 1 << 17
) -> np.ndarray:
    """Class labels (least position) of the fingerprints that are linked inside their group.

    `order` holds the permuted bits, sorted within each group; `lo_hi` the groups as index ranges;
    `start` the depth at which each group's trie begins. `side` is 0/1 for groups made of two parts
    of which only pairs across count (2: all pairs). Node pairs wait on a stack in chunks, deepest
    first, so memory is bounded by `chunk` pairs times the depth. Pairs of nodes whose leaves are all
    in one class already are dropped.
    """
    n = len(fp)
    label = np.arange(n)
    stack = []
    lo = np.array([a for a, b in lo_hi], dtype=np.int64)
    hi = np.array([b for a, b in lo_hi], dtype=np.int64)
    many = hi - lo > 1
    lo, hi, depth0 = lo[many], hi[many], start[many]
    for d in np.unique(depth0):
        at = depth0 == d
        stack.append((int(d), lo[at], hi[at], lo[at], hi[at], np.zeros(int(at.sum()), dtype=np.int8)))
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > chunk:
            for k in range(0, len(a0), chunk):
                s = slice(k, k + chunk)
                stack.append((depth, a0[s], a1[s], b0[s], b1[s], err[s]))
            continue
        if n > 4096:  # drop pairs whose leaves are one class
            change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            one = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])
            keep = ~one
            a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
            if not len(a0):
                continue
        size = (a1 - a0) * (b1 - b0)
        done = (size <= leaf) | (depth >= 64)
        if done.any():
            x0, x1, y0, y1 = a0[done], a1[done], b0[done], b1[done]
            sizes = (x1 - x0) * (y1 - y0)
            for part in np.array_split(np.arange(len(sizes)), max(1, int(sizes.sum() // (1 << 21)) + 1)):
                s = sizes[part]
                if not len(s):
                    continue
                owner = np.repeat(part, s)
                k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                wide = (y1 - y0)[owner]
                i, j = x0[owner] + k // wide, y0[owner] + k % wide
                ok = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & ((side[i] != side[j]) | (side[i] == 2))
                label = _unite(label, i[ok], j[ok])
        go = ~done
        if not go.any():
            continue
        a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        ones = np.concatenate([[0], np.cumsum((order >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        self_pair = (a0 == b0) & (a1 == b1)
        made = []
        for x0, x1, y0, y1, extra in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            keep = (x1 > x0) & (y1 > y0) & (err + extra <= max_bits)
            if (x0 is am) and (y0 is b0):  # of a node with itself, the crossing children count once
                keep &= ~self_pair
            keep &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
            made.append((x0[keep], x1[keep], y0[keep], y1[keep], (err + extra)[keep]))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*made))))
    return label


def _trie_task(batches: Iterator[pa.RecordBatch], choices: list, bounds: list, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, part key, head) -> star edges; a batch is cut at its last whole group."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch | None:
        fp = rows[:, 3].view(np.uint64)
        permuted = np.empty_like(fp)
        depth = np.empty(len(fp), dtype=np.int64)
        for c, chosen in enumerate(choices):
            at = rows[:, 0] == c
            if at.any():
                order = [bounds[k] for k in chosen] + [b for k, b in enumerate(bounds) if k not in chosen]
                permuted[at] = _permuted(fp[at], order)
                depth[at] = sum(b - a for a, b in order[: len(chosen)])
        idx = np.lexsort((permuted, rows[:, 1], rows[:, 2], rows[:, 0]))
        rows, fp, permuted, depth = rows[idx], fp[idx], permuted[idx], depth[idx]
        new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        begin = np.flatnonzero(new)
        label = trie_links(fp, permuted, depth[begin], list(zip(begin, [*begin[1:], len(fp)])), rows[:, 4], max_bits)
        at = np.flatnonzero(label != np.arange(len(fp)))
        if len(at):
            signed = fp.view(np.int64)
            pair = np.unique(np.stack([signed[at], signed[label[at]]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
        return None

    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        count += batch.num_rows
        if count < 200_000:
            continue
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        if len(last):
            whole = rows[: last[-1] + 1]
            held, count = [rows[last[-1] + 1 :]], len(rows) - len(whole)
            if (out := links(whole)) is not None:
                yield out
        else:
            held = [rows]
    if held and (out := links(np.concatenate(held))) is not None:
        yield out


def hamming_components(fps: DataFrame, fp: str, max_bits: int = 4, blocks: int = 6, max_group: int = 20_000) -> DataFrame:
    """(vertex, root) of every distinct fingerprint that is linked to another one."""
    return connected_components(hamming_edges(fps, fp, max_bits, blocks, max_group), "a", "b")


def hamming_edges(fps: DataFrame, fp: str, max_bits: int = 4, blocks: int = 6, max_group: int = 20_000) -> DataFrame:
    """(a, b): edges that span the classes of linked fingerprints, as stars of each trie.

    `fps` may repeat fingerprints; they are made distinct first. A trie whose head holds more than
    `max_group` fingerprints is dealt out: its rows fall into chunks, and every pair of chunks
    becomes a task group of its own, so no link is lost and no group is unbounded.
    """
    if not 0 <= max_bits < blocks <= 16:
        raise ValueError("blocks must exceed max_bits")
    bounds = _bounds(blocks)
    choices = list(combinations(range(blocks), blocks - max_bits))
    distinct = fps.select(F.col(fp).alias("fp")).distinct()

    def head(chosen):
        bits = F.lit(0).cast("bigint")
        for k in chosen:
            lo, hi = bounds[k]
            part = F.shiftrightunsigned("fp", 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            bits = F.shiftleft(bits, hi - lo).bitwiseOR(part)
        return bits

    heads = distinct.select("fp", F.posexplode(F.array(*[head(c) for c in choices])).alias("choice", "head"))
    big = heads.groupBy("choice", "head").count().where(F.col("count") > max_group)
    big = big.select("choice", "head", F.ceil(F.col("count") / max_group).cast("bigint").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    dealt = (
        heads.join(big, ["choice", "head"], "left")
        .withColumn("mine", F.when(F.col("chunks").isNull(), F.lit(-1).cast("bigint")).otherwise(mine))
        .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(other)))
        .select(
            F.col("choice").cast("bigint"),
            (F.least("mine", "other") * 1_000_000 + F.greatest("mine", "other")).alias("part"),
            "head",
            "fp",
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("bigint").alias("side"),
        )
    )

    def task(batches):
        return _trie_task(batches, choices, bounds, max_bits)

    return (
        dealt.repartition("choice", "head", "part")
        .sortWithinPartitions("choice", "part", "head")
        .mapInArrow(task, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    `fingerprint` is 16 lowercase hex digits. `component_id` is the least doc_id that links of at
    most `max_bits` differing bits reach, its own included. Null or blank texts have fingerprint
    zero and are linked like any other. A null doc_id keeps its row and never names a component
    unless all of its members are null. Repeated rows each return a row. An empty table gives none.
    """
    named, bits = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", width)
    fps = cut(named.select("doc_id", F.col(bits).alias("fp")))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = hamming_components(classes, "fp", max_bits)
    member = classes.join(linked, classes.fp == linked.vertex, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A class may hold a third of all fingerprints, and a fingerprint a third of all rows.
    by_fp = spread_join(member, least, "root").select("fp", "component_id")
    return spread_join(fps, by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """`docs` with one document of every component of near-duplicates: that of the least doc_id.

    Rows that repeat a doc_id are one document; the first by text stays. Rows without a doc_id stay.
    """
    return drop_members(docs, near_duplicates(docs, doc_id, text, width, max_bits), doc_id, text)


def drop_members(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` without the documents that `found` (doc_id, component_id) puts under another doc_id."""
    found = cut(found.where("doc_id IS NOT NULL").select("doc_id", "component_id"))
    gone = found.where("doc_id <> component_id").select("doc_id")
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = by_ids(docs, doc_id, gone, "left_anti")
    if repeated.isEmpty():
        return left
    rank = free_name(docs.columns, "_rank")
    once, more = by_ids(left, doc_id, repeated, "left_anti"), by_ids(left, doc_id, repeated, "left_semi")
    order = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last())
    return once.unionByName(more.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank))
