"""Packing tokenised documents into sequences as a cutting-stock problem.

Each document is cut into whole sequences of `capacity` tokens and one shorter rest. Lengths are
rounded up to `step` tokens, which leaves at most capacity/step length classes, so the histogram
that the driver solves has a fixed size whatever the corpus. Column generation solves the linear
program over cutting patterns: a revised simplex keeps the basis, and an unbounded-knapsack dynamic
program prices new columns from the duals. Pattern counts are rounded down; the pieces left over
(at most one sequence a class) are placed first-fit decreasing. Documents are cut into whole sequences and a
rest; rests are never cut.

Pieces are ranked within their class without gathering a class in one task: each class is spread
over `buckets` hash buckets, ranked inside a bucket, and shifted by the counts of earlier buckets.
A rank then falls into the interval of exactly one pattern slot, which gives the sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bpe, cut, default_ranks

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces_of(docs: DataFrame, doc_id: str, text: str, capacity: int, end_id: int, special: int | None, vocabulary: str | None) -> DataFrame:
    path = vocabulary or default_ranks()
    special_text = "<|endoftext|>"

    def ids_of(t: str) -> bytes:
        tokens = bpe(path)
        if special is None or special_text not in t:
            return tokens.raw(t)
        return np.array([special], dtype="<u4").tobytes().join(tokens.raw(x) for x in t.split(special_text))

    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                out: list[tuple] = []
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = ids_of(t or "") + end
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        piece = raw[4 * s : 4 * (s + capacity)]
                        out.append((key, s, len(piece) // 4, zlib.crc32(piece), n))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, PIECES)


def price(duals: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The best pattern for the duals of lengths 1..units: an unbounded knapsack of size `units`."""
    best, last = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for c in range(1, units + 1):
        value = best[c - 1 :: -1][:c] + duals[:c]  # after a last item of length 1..c
        k = int(np.argmax(value))
        if value[k] > best[c - 1] + 1e-12:
            best[c], last[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(units, dtype=np.int64), units
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[units]), pattern


def _first_fit(counts: np.ndarray, units: int) -> Iterator[tuple[np.ndarray, int, list[int]]]:
    """First-fit decreasing, one pattern at a time as often as it fits whole, and the lengths it uses up."""
    left = counts.astype(np.int64).copy()
    while left.any():
        pattern, room = np.zeros(units, dtype=np.int64), units
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), room // (k + 1))
            pattern[k] += n
            room -= n * (k + 1)
            if not room:
                break
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        before = left.copy()
        left -= pattern * times
        yield pattern, times, np.flatnonzero((before > 0) & (left == 0)).tolist()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix by vector or matrix, without a threaded library: its threads can stand still beside the driver's JVM."""
    return (a * b).sum(axis=1) if b.ndim == 1 else np.stack([(a * b[:, k]).sum(axis=1) for k in range(b.shape[1])], axis=1)


def _inverse(basis: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan elimination with row pivots; null if the matrix is singular or the result is not exact enough."""
    n = len(basis)
    work = np.concatenate([basis, np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.argmax(np.abs(work[k:, k])))
        if abs(work[p, k]) < 1e-9:
            return None
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k][None]
    out = work[:, n:]
    return out if np.abs(_times(out, basis) - np.eye(n)).max() < 1e-6 else None


def cutting_patterns(counts: np.ndarray, units: int, max_columns: int = 1500, gap: float = 2e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns over lengths 1..units with whole counts, and every item of `counts` in exactly one.

    `counts[k]` items have length k + 1. The basis starts from first-fit decreasing; columns
    come from `price` until the linear program is within `gap` of its bound or `max_columns` were made. Any basis is a valid
    plan, so stopping early costs padding only.
    """
    kinds = np.flatnonzero(counts)
    out: list[tuple[np.ndarray, int]] = []
    left = counts.astype(np.int64).copy()
    if len(kinds):
        # First-fit decreasing gives the first basis: each of its patterns uses up a length that no later
        # one holds, so the matrix is triangular; lengths used up together get a column of their own.
        basis = np.zeros((len(kinds), len(kinds)))
        taken, row = 0, {int(k): i for i, k in enumerate(kinds)}
        for pattern, _, gone in _first_fit(counts, units):
            for extra, k in enumerate(gone):
                column = pattern if not extra else np.eye(units, dtype=np.int64)[k] * (units // (k + 1))
                basis[:, taken] = column[list(row)]
                taken += 1
        inverse = _inverse(basis)
        if inverse is None:  # rounding made a long chain singular: one pattern a length
            basis = np.diag((units // (kinds + 1)).astype(float))
            inverse = np.diag(1.0 / np.diag(basis))
        # A small fixed disturbance keeps ties from stalling the simplex; whole counts come from rounding below.
        need = counts[kinds] + 0.02 * np.modf(0.6180339887 * np.arange(1, len(kinds) + 1))[0]
        x = np.maximum(_times(inverse, need), 0)
        for k in range(max_columns):
            duals = np.zeros(units)
            duals[kinds] = inverse.sum(axis=0)  # every pattern costs one sequence
            value, pattern = price(np.maximum(duals, 0), units)
            if value <= 1 + gap:
                break
            column = pattern[kinds].astype(float)
            step = _times(inverse, column)
            ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
            r = int(np.argmin(ratio))
            if not np.isfinite(ratio[r]):
                break
            basis[:, r] = column
            theta = ratio[r]
            x = np.maximum(x - theta * step, 0)
            x[r] = theta
            pivot = inverse[r] / step[r]
            inverse -= step[:, None] * pivot[None]
            inverse[r] = pivot
            if k % 100 == 99:
                fresh = _inverse(basis)
                if fresh is None:
                    break
                inverse, x = fresh, np.maximum(_times(fresh, need), 0)
        for j in np.argsort(-x, kind="stable"):
            full = np.zeros(units, dtype=np.int64)
            full[kinds] = np.rint(basis[:, j]).astype(np.int64)
            some = full > 0
            times = min(int(np.floor(x[j] + 1e-6)), int((left[some] // full[some]).min()))
            if times > 0:
                out.append((full, times))
                left -= full * times
    return out + [(pattern, times) for pattern, times, _ in _first_fit(left, units)]


def _intervals(patterns: list[tuple[np.ndarray, int]], units: int) -> list[list[np.ndarray]]:
    """For each class: (first rank, pieces a sequence, first sequence id) of every pattern that holds it, by rank."""
    begin, first = np.zeros(units, dtype=np.int64), 0
    rows: list[list[tuple]] = [[] for _ in range(units)]
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            rows[k].append((begin[k], pattern[k], first))
            begin[k] += pattern[k] * times
        first += times
    return [list(np.array(r, dtype=np.int64).reshape(-1, 3).T) for r in rows]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    step: int = 8,
    end_id: int = 1,
    special: int | None = 50256,
    vocabulary: str | None = None,
    buckets: int = 256,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its document is the end token alone. Repeated rows are packed each for
    itself. Rows with a null doc_id are packed as well. An empty table gives an empty result.
    Ties in length are ranked by hash bucket, then doc_id and start. Sequence ids run from 0 without
    gaps, offsets in a sequence from 0 without gaps.
    """
    if capacity % step:
        raise ValueError("step must divide capacity")
    units = capacity // step
    pieces = pieces_of(docs, doc_id, text, capacity, end_id, special, vocabulary)
    pieces = cut(
        pieces.withColumn("kind", F.ceil(F.col("length") / step).cast("int")).withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.lit(buckets)).cast("int")
        )
    )
    # At most units x buckets rows.
    table = pieces.groupBy("kind", "bucket").count()
    sizes = np.zeros((units, buckets), dtype=np.int64)
    for r in table.collect():
        sizes[r["kind"] - 1, r["bucket"]] = r["count"]
    shift = np.cumsum(sizes, axis=1) - sizes
    slots = _intervals(cutting_patterns(sizes.sum(axis=1), units), units)

    rank = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32", "length"))
    ranked = pieces.withColumn("rank", rank.cast("bigint") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, bucket, rank = (batch.column(n).to_numpy() for n in ("kind", "bucket", "rank"))
            k = kind.astype(np.int64) - 1
            overall = shift[k, bucket] + rank
            sequence = np.zeros(len(k), dtype=np.int64)
            for one in np.unique(k):
                at = k == one
                begin, width, first = slots[one]
                i = np.searchsorted(begin, overall[at], side="right") - 1
                sequence[at] = first[i] + (overall[at] - begin[i]) // width[i]
            keep = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    placed = ranked.mapInArrow(place, PIECES + ", sequence_id bigint")
    # A sequence holds at most `capacity` pieces, so its window is bounded.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("bigint"))
