"""Near copies by word shingles: SimHash trie links, verified and completed to an exact similarity join.

Two documents are near copies if their sets of `width`-word shingles have a Jaccard similarity of
`percent` % or more; one document of every group of near copies stays.

1. SimHash: each distinct set gets a fingerprint; the binary-trie self-join of `simhash` links fingerprints
   within its error budget. Each linked set is tried with the first set of its class.
2. Sets of similarity 0.8 differ in ten of 64 bits on average, so no budget that a trie can prune by finds all
   of them. The rest comes from prefixes: in any fixed order of all shingles, near copies share a shingle among
   the first n - ceil(n * percent %) + 1 of each. Shingles that a sample finds common come last in that
   order, which keeps groups small and changes no result. Every set is tried with a leader of each group.
3. What these links have not joined is tried in pairs of different classes of a prefix group, in rounds: each class
   offers its closest untried pairs of a group, what verifies joins classes, and groups that held pairs back go on.

Bounds on sizes and places and parity bitmaps, which can only drop pairs that are no near copies, come before
a pair's verification on the whole texts (64-bit hashes of shingles). So a group makes at most a few rows a class and
round, whatever its square, and no link is lost: the rounds end when no group holds a pair back. Bitmaps of a group are
still compared in all pairs of its classes, inside a task. Groups of more than `HOT` sets are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import CACHES, append_columns, cut, release, spread_join, stored
from newsloom.llm.graph import connected_components
from newsloom.llm.simhash import drop_members, hamming_edges

#: Sets that one task group may hold; larger groups are dealt out.
HOT = 20_000
#: Pairs that a class of a group offers in the first round, and at most in a later one.
FEW, MANY = 2, 128
#: Bits of the filter that keeps most texts which no pair needs out of a shuffle; fixed, whatever the input.
FILTER_BITS = 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_WORDS: dict[bytes, int] = {}
CACHES.append(_WORDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def digest_of(text: str | None) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def shingles(text: str | None, width: int = 5) -> tuple[bytes, np.ndarray]:
    """A digest of the text's words, and its sorted distinct shingle hashes; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if len(words) < width:
        return digest, np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)] if words else [], dtype=np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    get, ids = _WORDS.get, []
    for w in words:
        x = get(w)
        if x is None:
            x = _WORDS[w] = xxhash.xxh64_intdigest(w, 42)
        ids.append(x)
    ids = np.array(ids, dtype=np.uint64)
    n = len(ids) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = _mix(out + ids[k : k + n] * _ODD[k % len(_ODD)])
    return digest, np.unique(out)


def fingerprint(ids: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    bits = np.zeros(64, dtype=np.int64)
    raw = ids.view(np.uint8).reshape(len(ids), 8)
    for k in range(0, len(ids), 8192):
        bits += np.unpackbits(raw[k : k + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(ids)).view(np.int64)[0])


def needed(n, percent: int):
    """Least overlap that a set of n shingles has with any near copy."""
    return -(-n * percent // 100)


def parities(ids: np.ndarray) -> bytes:
    """A bit for every residue of the hashes: is their number odd? At least twice as many bits as hashes.

    The bitmaps of two sets differ in at most as many bits as the sets in elements; a longer one folds to
    a shorter one by exclusive or of its halves.
    """
    bits = 64
    while bits < 2 * len(ids):
        bits *= 2
    odd = np.bincount((ids & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap at `size` bytes."""
    x = np.frombuffer(bitmap, dtype=np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _differ(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _most_differing(sa, sb, percent: int):
    """Most elements in which two near copies of these sizes differ."""
    return sa + sb - 2 * (-(-percent * (sa + sb) // (100 + percent)))


def _common(docs: DataFrame, text: str, width: int, sample: int, least: int, share: float, most: int) -> dict[int, tuple[int, int]]:
    """The most frequent shingles of a sample with their places in the order and counts; at most `most`."""
    chosen = docs.where(F.pmod(F.xxhash64(text), F.lit(sample)) == 0).select(text)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t, width)[1] for t in batch.column(0).slice(at, 512).to_pylist()]
                u, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["token", "c"])

    counts = chosen.mapInArrow(every, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    floor = max(least, int(share * chosen.count()))
    rows = counts.where(F.col("c") >= floor).orderBy(F.desc("c"), "token").limit(most).collect()
    return {r["token"]: (k + 1, r["c"]) for k, r in enumerate(reversed(rows))}


def _prefix(ids: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    n = len(ids)
    signed, (tokens, places) = ids.view(np.int64), common
    rank = np.zeros(n, dtype=np.int64)
    if len(tokens) and n:
        at = np.minimum(np.searchsorted(tokens, signed), len(tokens) - 1)
        rank = np.where(tokens[at] == signed, places[at], 0)
    order = np.lexsort((signed, rank))
    return signed[order[: n - needed(n, percent) + 1]] if n else signed


def _may_match(sa, sb, pa_, pb, percent: int) -> np.ndarray:
    """Can sets of these sizes, with a shared shingle at these places of the order, be near copies?"""
    least = -(-percent * (sa + sb) // (100 + percent))
    return (100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)) & (np.minimum(pa_, pb) + 1 + np.minimum(sa - pa_, sb - pb) - 1 >= least)


def _may_start(sa, sb, pa_, pb, percent: int) -> np.ndarray:
    """Can sets of these sizes be near copies whose first shared shingle stands at these places of the order?

    Every near copy passes in the group of that shingle; before it, neither set holds any of the other's.
    """
    least = -(-percent * (sa + sb) // (100 + percent))
    return (100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)) & (np.minimum(sa - pa_, sb - pb) >= least)


def _groups(batches: Iterator[pa.RecordBatch], size: int = 100_000) -> Iterator[tuple[np.ndarray, list]]:
    """Rows of numbers and a last column of bytes, sorted by their first column, in pieces that end where a group does."""
    held, bytes_, count = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1))
        bytes_ += batch.column(batch.num_columns - 1).to_pylist()
        count += batch.num_rows
        if count < size:
            continue
        rows = np.concatenate(held)
        last = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
        if len(last):
            yield rows[: last[-1] + 1], bytes_[: last[-1] + 1]
            rows, bytes_ = rows[last[-1] + 1 :], bytes_[last[-1] + 1 :]
        held, count = [rows], len(rows)
    if held and count:
        yield np.concatenate(held), bytes_


def _filter_of(want: DataFrame) -> np.ndarray:
    """A bit for the hash of every first_id; at most 2 ** (FILTER_BITS - 6) words come to the driver."""
    at = F.xxhash64("first_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = want.select(at.alias("at")).selectExpr("at >> 6 AS word", "shiftleft(1L, int(at & 63)) AS bit")
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


SHARED = "token bigint, id bigint, at bigint, leader bigint, near boolean"
PAIRS = "a bigint, b bigint"
OFFERED = "group bigint, a bigint, b bigint, more boolean"


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, place) of postings."""
    return at >> 32, at & 0xFFFFFFFF


def _leaders(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Postings (token, part, id, at), sorted so that a group's leader comes first -> those of shared tokens, with it.

    Only a batch, the leader and one row before it are held, however large a group is.
    """

    def judged(rows: np.ndarray, lead: np.ndarray, also: bool) -> pa.RecordBatch:
        """`also`: the last row's group goes on."""
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        leads = rows[first]
        leads[first == 0] = lead
        own = rows[:, 2] == leads[:, 2]
        some = ~own | np.concatenate([~new[1:], [also]]) | (rows[:, 1] >= 0)
        rows, leads = rows[some], leads[some]
        near = _may_match(*(x for pair in zip(_places(rows[:, 3]), _places(leads[:, 3])) for x in pair), percent) & (rows[:, 2] != leads[:, 2])
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in (0, 2, 3)] + [pa.array(leads[:, 2]), pa.array(near)], names=["token", "id", "at", "leader", "near"])

    lead = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch)
        if last is not None:
            rows = np.concatenate([last, rows])
        same = lead is not None and (rows[0, :2] == lead[:2]).all()
        lead = lead if same else rows[0]
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        if len(rows) > 1:
            yield judged(rows[:-1], lead, bool((rows[-1, :2] == rows[-2, :2]).all()))
        last = rows[-1:]
        lead = lead if not len(new) else rows[new[-1] + 1]
    if last is not None:
        yield judged(last, lead, False)


def _closest(x: np.ndarray, y: np.ndarray, score: np.ndarray, kind: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows those among the `most` of least score of either row's class, and the others."""
    order = np.lexsort((y, x, score))
    ends = np.concatenate([kind[x[order]], kind[y[order]]])
    by = np.argsort(ends * len(order) + np.tile(np.arange(len(order)), 2))
    starts = np.flatnonzero(np.concatenate([[True], ends[by[1:]] != ends[by[:-1]]]))
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by)) - np.repeat(starts, np.diff([*starts, len(by)]))
    some = np.minimum(rank[: len(order)], rank[len(order) :]) < most
    return order[some], order[~some]


def _across(batches: Iterator[pa.RecordBatch], percent: int, most: int, chunk: int = 1 << 18, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Pairs of a group that have different roots, pass all bounds and are among the `most` closest of a root; with `more` if others are left.

    Rows are (group, side, root, id, at, leader, parities) by group and root. Of a group with sides 0 and 1 only pairs across
    the sides count (2: all). Pairs with a leader are tried before; so are those that rows of side -1 name as (root, id).
    """
    for rows, bitmaps in _groups(batches):
        own = rows[:, 1] >= 0
        told, rows = rows[~own], rows[own]
        bitmaps = [x for x, k in zip(bitmaps, own) if k]
        n = len(rows)
        if not n:
            continue
        group, side, root, ids, lead = (rows[:, k] for k in (0, 1, 2, 3, 5))
        names, code = np.unique(ids, return_inverse=True)
        groups, nth = np.unique(group, return_inverse=True)
        key = lambda g, a, b: (g * len(names) + np.minimum(a, b)) * len(names) + np.maximum(a, b)
        told = told[np.isin(told[:, 0], groups)]  # a group whose classes have met since has no rows
        told = np.unique(key(np.searchsorted(groups, told[:, 0]), *(np.searchsorted(names, told[:, k]) for k in (2, 3))))
        end = np.searchsorted(group, group, "right")
        run = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (root[1:] != root[:-1])]))
        after = np.repeat([*run[1:], n], np.diff([*run, n]))  # the first row behind this one's root
        wide = np.maximum(end - after, 0)
        total = np.cumsum(wide)
        size, place = _places(rows[:, 4])
        bits = np.array([len(x) for x in bitmaps])
        x, y, score = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, float))
        left = np.zeros(len(groups), dtype=bool)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
            w = wide[at:to]
            i = np.repeat(np.arange(at, to), w)
            j = np.repeat(after[at:to], w) + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            ok = _may_start(size[i], size[j], place[i], place[j], percent) & ((side[i] != side[j]) | (side[i] == 2)) & (lead[i] != ids[j]) & (lead[j] != ids[i])
            i, j = i[ok], j[ok]
            if len(told) and len(i):
                these = key(nth[i], code[i], code[j])
                new = told[np.minimum(np.searchsorted(told, these), len(told) - 1)] != these
                i, j = i[new], j[new]
            level = np.minimum(bits[i], bits[j])
            for words in np.unique(level):
                these = np.flatnonzero(level == words)
                step = max(1, most_bytes // int(words))
                for k in range(0, len(these), step):
                    p, q = i[these[k : k + step]], j[these[k : k + step]]
                    kinds, which = np.unique(np.concatenate([p, q]), return_inverse=True)
                    table = np.stack([_folded(bitmaps[r], int(words)) for r in kinds])
                    differ = np.bitwise_count(table[which[: len(p)]] ^ table[which[len(p) :]]).sum(axis=1, dtype=np.int64)
                    limit = _most_differing(size[p], size[q], percent)
                    some = differ <= limit
                    x, y = np.concatenate([x, p[some]]), np.concatenate([y, q[some]])
                    score = np.concatenate([score, (differ / np.maximum(limit, 1))[some]])
            if len(x):
                kept, others = _closest(x, y, score, after, most)
                left[nth[x[others]]] = True
                x, y, score = x[kept], y[kept], score[kept]
                done = nth[x] < (nth[to] if to < n else len(groups))
                if done.any():
                    yield _offered(group[x[done]], ids[x[done]], ids[y[done]], left[nth[x[done]]])
                    x, y, score = x[~done], y[~done], score[~done]
            at = to


def _offered(group: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (group, np.minimum(a, b), np.maximum(a, b), more)], names=["group", "a", "b", "more"])


def _by_parities(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        most = _most_differing(sa, sb, percent)
        ok = [_differ(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _own(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of (id, node, text) those texts that are the node's; rows that repeat a doc_id may hold others."""
    for batch in _slices(batches):
        ok = [shingles(t, width)[0] == node for node, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 2)], names=["id", "text"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of texts in small parts, so that only a part is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _by_texts(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) whose whole sets are similar; the last text's set is kept for the next pair."""
    held: tuple = (None, None)
    for batch in _slices(batches):
        ok = []
        for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if held[0] != s:
                held = (s, shingles(s, width)[1])
            x, y = held[1], shingles(t, width)[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, max_bits: int = 4, sample: int = 16) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id.

    `component_id` is the least doc_id that links between near copies reach, its own included. Words are
    what ASCII blanks part, A-Z lower-cased; a text of fewer than `width` words is one shingle; null and
    blank texts are copies of each other. Repeated rows each return a row. An empty table gives none.
    `max_bits` is the trie's error budget; it shares out the work and changes no result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    found = _common(named, "text", width, sample, 8, 2e-4, 500_000)
    tokens = np.array(sorted(found), dtype=np.int64)
    common = spark.sparkContext.broadcast((tokens, np.array([found[t][0] for t in tokens.tolist()], dtype=np.int64)))

    def sketch(texts: list) -> list:
        release(_WORDS)
        made = [shingles(t, width) for t in texts]
        return [
            [d for d, _ in made],
            [len(s) for _, s in made],
            [fingerprint(s) for _, s in made],
            [parities(s) for _, s in made],
            [_prefix(s, common.value, percent) for _, s in made],
        ]

    fields = [("node", T.BinaryType()), ("size", T.LongType()), ("fp", T.LongType()), ("parities", T.BinaryType()), ("prefix", T.ArrayType(T.LongType()))]
    sketches = append_columns(named, "text", fields, sketch)[0].drop("text")
    sets = sketches.groupBy("node").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("size", "fp", "parities", "prefix")))
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        side = sets.select("id", "size", "parities")
        left = pairs.join(side.toDF("a", "sa", "pa"), "a").join(side.toDF("b", "sb", "pb"), "b").select("a", "b", "sa", "sb", "pa", "pb")
        left = cut(left.mapInArrow(lambda x: _by_parities(x, percent), PAIRS))
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        want = cut(ids.join(sets, "id").select("id", "node", "first_id"))
        wanted = spark.sparkContext.broadcast(_filter_of(want))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
                hit = (wanted.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in batch.columns[1:]], names=["doc_id", "text"])

        texts = named.select(F.xxhash64("doc_id").alias("hash"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(some, named.schema)
        texts = texts.join(want.withColumnRenamed("first_id", "doc_id"), "doc_id").select("id", "node", "text")
        texts = texts.mapInArrow(lambda x: _own(x, width), "id bigint, text string")
        texts = stored(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")
        both = left.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
        return cut(both.mapInArrow(lambda x: _by_texts(x, width, percent), PAIRS))

    # 1. The trie's stars: the first sets of two linked fingerprints, and each set with the first of its fingerprint.
    first = cut(sets.groupBy("fp").agg(F.min("id").alias("first")))
    named_first = lambda c, name: first.select(F.col("fp").alias(c), F.col("first").alias(name))
    stars = hamming_edges(first, "fp", max_bits).join(named_first("a", "x"), "a").join(named_first("b", "y"), "b")
    starred = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    starred = starred.unionByName(spread_join(sets.select("id", "fp"), first, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))

    # 2. Prefix groups: each set with its group's leader. A hot token's sets are dealt to parts with leaders of their own.
    at = F.shiftleft(F.col("size"), 32).bitwiseOR(F.col("place").cast("bigint")).alias("at")
    postings = sets.select(F.posexplode("prefix").alias("place", "token"), "id", "size").select("token", "id", at)
    part = F.lit(-1).cast("bigint")
    hot = [(t, -(-c * sample // HOT)) for t, (_, c) in found.items() if c * sample > HOT]  # at most `most` of _common
    if hot:
        postings = postings.join(F.broadcast(spark.createDataFrame(hot, "token bigint, parts bigint")), "token", "left")
        part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), part)
    postings = postings.select("token", part.alias("part"), "id", "at").repartition("token", "part")
    postings = postings.sortWithinPartitions("token", "part", F.xxhash64("id", F.col("token").bitwiseAND(3)))
    shared = stored(postings.mapInArrow(lambda x: _leaders(x, percent), SHARED), "shared")
    tried = starred.unionByName(shared.where("near").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")))
    if hot:
        leaders = shared.join(F.broadcast(spark.createDataFrame([(t,) for t, _ in hot], "token bigint")), "token", "left_semi").select("token", "leader").distinct()
        first = leaders.groupBy("token").agg(F.min("leader").alias("a"))
        tried = tried.unionByName(leaders.join(first, "token").where("a <> leader").select("a", F.col("leader").alias("b")))
    tried = cut(tried.distinct())
    links = verified(tried)

    # 3. Pairs of different classes in the groups that still hold some, the closest of each class first.
    tops = connected_components(links, "a", "b")
    every, most = None, FEW
    while True:
        rows = shared.join(tops.toDF("id", "root"), "id", "left").select("token", F.coalesce("root", "id").alias("root"), "id", "at", "leader")
        mixed = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 AND low < high")
        dealt = rows.join(mixed.select("token", F.ceil(F.col("n") / HOT).cast("bigint").alias("chunks")), "token")
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("bigint")
        dealt = dealt.select(F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), side.alias("side"), "root", "id", "at", "leader")
        if every is not None:
            dealt = dealt.join(open_, "group", "left_semi")
        dealt = dealt.join(sets.select("id", "parities"), "id").select("group", "side", "root", "id", "at", "leader", "parities")
        if every is not None:
            number = lambda x, name: F.lit(x).cast("bigint").alias(name)
            told = told.select("group", number(-1, "side"), F.col("a").alias("root"), F.col("b").alias("id"), number(0, "at"), number(0, "leader"), F.lit(b"").alias("parities"))
            dealt = dealt.unionByName(told)
        offers = cut(dealt.repartition("group").sortWithinPartitions("group", "root").mapInArrow(lambda x, m=most: _across(x, percent, m), OFFERED))
        pairs = cut(offers.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            # The classes so far are stars already, so only what is new takes rounds.
            tops = connected_components(tops.toDF("a", "b").unionByName(verified(pairs)), "a", "b")
            tried = tried.unionByName(pairs)
        open_ = offers.where("more").select("group").distinct()
        if open_.isEmpty():
            break
        every = offers if every is None else every.unionByName(offers)
        told = every.select("group", "a", "b").join(open_, "group", "left_semi")
        most = min(4 * most, MANY)
    member = sets.join(tops.toDF("id", "root"), "id", "left").select("node", "first_id", F.coalesce("root", "id").alias("root"))
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = spread_join(member, least, "root").select("node", "component_id")
    # Digests are made again: keeping the sketches of all rows would cost a third of the texts' size on disk.
    nodes = append_columns(named, "text", fields[:1], lambda texts: [[digest_of(t) for t in texts]])[0].select("doc_id", "node")
    return spread_join(nodes, by_node, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one document of every group of near copies: that of the least doc_id. Rows without a doc_id stay."""
    return drop_members(docs, near_copies(docs, doc_id, text, **options), doc_id, text)
