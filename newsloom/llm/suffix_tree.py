"""A probabilistic suffix tree over words, and the log-probability of whole texts under it.

Symbols are lower-cased words and an end symbol. The root predicts by smoothed counts of all training
symbols. A node is a context of 1 to `depth` words that precede a symbol `least` times or more in training. Its
distribution is that of its parent (its longest kept proper suffix) mixed with its own counts by
Witten-Bell weights, so each node sums to one:

    p(s | c) = (n(c, s) + d(c) p(s | parent)) / (n(c) + d(c)),   d(c): distinct symbols seen after c.

A context is kept if its distribution diverges from its parent's: the training symbols that follow it, each
predicted without its own count, must gain at least `divergence` nats over the parent. A symbol is scored at the
longest kept suffix of what precedes it. Counts are absolute, so words, contexts and listed symbols grow with the
corpus; none of them is gathered on the driver or broadcast.

How it runs: blocks of documents become word numbers plus a vocabulary each. The vocabularies meet by class of words,
which gives every word its count and a corpus-wide number, and return to their blocks. Then each symbol travels once, with
its last `depth` words, to the task of the last one: there the whole branch of the tree below that word is
counted, tested and used, and sums per document go back. A last word that is counted more than `hot` times has its
branch split by classes of the word before it. Only its one-word context spans classes, so that one is counted beforehand:
pairs of a hot word and what follows it are summed by block, then by class of pairs, and each block gets
the counts of its own pairs back. The tree is the same wherever `hot` stands.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

END = b"\n"  # no word holds a blank
ALPHA = 0.1
#: Most documents of a block.
BLOCK_DOCS = 1 << 15
#: Numbers of words stay below 2 ** 44; which part of a hot word's branch is meant stands above.
CLASS_BITS = 44


def symbols(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def is_held_out(doc_id: int | None, folds: int = 10) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte of each number, compressed."""
    parts = [struct.pack("<B", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8")
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        parts += [struct.pack("<QB", len(c), width), np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first as it is."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def spread(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1
    for _ in range(raw[0]):
        n, width = struct.unpack_from("<QB", raw, at)
        at += 9
        column = np.zeros((n, 8), dtype=np.uint8)
        column[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        out.append(column.view("<u8").ravel())
        at += n * width
    return out


# ------------------------------------------------------------------------------------------ one branch


def branch(key: np.ndarray, before: list[np.ndarray], symbol: np.ndarray, p0: np.ndarray, train: np.ndarray, least: int, divergence: float, given: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of symbols at the longest kept suffix, for whole branches of the tree.

    `key` is the one-word context of each symbol, `before` the words before that one, nearest first (0: the text
    begins), `p0` the root's probability. Only `train` symbols are counted. Longer contexts are known by 64-bit hashes.
    Where `given` is above 0 it is the probability at the one-word context, which is not counted here then.
    """
    p, at = p0.copy(), np.arange(len(key))
    context = key
    ready = np.flatnonzero(given > 0) if given is not None else at[:0]
    if len(ready):
        p[ready] = given[ready]
        at = np.flatnonzero(given <= 0)
        context = key[at]
    for k in range(len(before) + 1):
        if k == 1 and len(ready):
            at, context = np.concatenate([at, ready]), np.concatenate([context, key[ready]])
        if k:
            here = before[k - 1][at] > 0
            at, context = at[here], mix(context[here] * np.uint64(0x9E3779B97F4A7C15) + before[k - 1][at[here]])
            before[k - 1] = None  # not needed again
        if not len(at):
            if k == 0:
                continue
            break
        code = np.unique(context, return_inverse=True)[1]
        n = np.bincount(code[train[at]], minlength=int(code.max()) + 1)
        often = n[code] >= least
        at, context, code = at[often], context[often], code[often]
        if not len(at):
            continue
        first, pair = np.unique(mix(mix(context) + symbol[at]), return_index=True, return_inverse=True)[1:]
        mine = train[at]
        both = np.bincount(pair[mine], minlength=len(first))
        kinds = np.bincount(code[first[both > 0]], minlength=len(n))
        a, c, d, parent = both[pair], n[code], kinds[code], p[at]
        alone = (a[mine] - 1 + d[mine] * parent[mine]) / (c[mine] - 1 + d[mine])
        gain = np.bincount(code[mine], weights=np.log(alone / parent[mine]), minlength=len(n))
        kept = gain[code] >= divergence
        p[at[kept]] = (a[kept] + d[kept] * parent[kept]) / (c[kept] + d[kept])
    return p


# ------------------------------------------------------------------------------------------ tasks

BLOCKS = "block bigint, class int, docs binary, symbols binary, words binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch], most: int, classes: int) -> Iterator[pa.RecordBatch]:
    """A row per block with its documents (id, no id, held out, length) and symbols, and a row per class of its words.

    Words are dealt to classes by their hash and sorted inside; `symbols` numbers words by first appearance and tells
    the place of each in that order.
    """
    block = TaskContext.get().partitionId() << 32
    schema = pa.schema([("block", pa.int64()), ("class", pa.int32()), *((n, pa.binary()) for n in ("docs", "symbols", "words", "counts"))])
    numbers: dict[bytes, int] = {}
    ids, docs = array("I"), []

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal block, ids
        key, none, held, length = np.array(docs, dtype=np.int64).T
        flat = np.frombuffer(ids, dtype=np.uint32)
        c = np.bincount(flat[np.repeat(held == 0, length)], minlength=len(numbers))
        words = list(numbers)
        of = np.fromiter((zlib.crc32(w) % classes for w in words), dtype=np.int64, count=len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
        order = order[np.argsort(of[order], kind="stable")]
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        packed = [squeeze(key.view(np.uint64), none, held, length), squeeze(flat, place)]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in packed), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=schema)
        kinds, begin = np.unique(of[order], return_index=True)
        end, press = [*begin[1:], len(words)], zstandard.ZstdCompressor(level=3).compress
        # The end symbol is an empty line; no word is empty or holds a blank.
        texts = [press(b"\n".join([words[k] if words[k] != END else b"" for k in order[x:y]])) for x, y in zip(begin, end)]
        counts = [squeeze(c[order[x:y]]) for x, y in zip(begin, end)]
        none = pa.nulls(len(kinds), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), block)), pa.array(kinds, pa.int32()), none, none, pa.array(texts, pa.binary()), pa.array(counts, pa.binary())], schema=schema)
        block += 1
        numbers.clear()
        docs.clear()
        ids = array("I")

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = symbols(text)
            ids.extend([numbers.setdefault(w, len(numbers)) for w in found])
            docs.append((doc or 0, doc is None, is_held_out(doc), len(found)))
            if len(ids) >= most or len(docs) >= BLOCK_DOCS:
                yield from out()
    if docs:
        yield from out()


NUMBERED = "block bigint, class int, words binary, known bigint, total bigint"


def _numbered(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, block, words, counts) by class -> the corpus-wide number and count of each word of a block.

    Numbers go by rank inside a class and then by class, so frequent words have small ones; none is 0. The first
    row of a class tells its distinct and its counted training symbols.
    """
    now, held = None, []

    def out() -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        words = [unpack(w).split(b"\n") for _, w, _ in held]
        counts = [spread(c)[0].astype(np.int64) for _, _, c in held]
        kind = pa.array([w for part in words for w in part], pa.binary()).dictionary_encode().indices.to_numpy()
        total = np.bincount(kind, weights=np.concatenate(counts)).astype(np.int64)
        place = np.empty(len(total), dtype=np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(total))
        gid = place * classes + now + 1
        ends = np.cumsum([len(w) for w in words])
        made = [squeeze(gid[k], total[k]) for k in np.split(kind, ends[:-1])]
        first = np.arange(len(held)) == 0
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in held]), pa.array([now] * len(held), pa.int32()), pa.array(made, pa.binary()), pa.array(np.where(first, (total > 0).sum(), 0)), pa.array(np.where(first, total.sum(), 0))],
            names=["block", "class", "words", "known", "total"],
        )

    for batch in batches:
        for k in range(batch.num_rows):
            kind, block, words, counts = (c[k].as_py() for c in batch.columns)
            if kind != now and held:
                yield out()
                held.clear()
            now = kind
            held.append((block, words, counts))
    if held:
        yield out()


def _dictionaries(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Rows by block and class -> a row per block with the numbers and counts of its words in order of their places, and its hot words."""
    now, held, sums = None, [], [0, 0]

    def out() -> pa.RecordBatch:
        gid, count = (np.concatenate(p) for p in zip(*held))
        many = pa.array([gid[count > hot].astype(np.int64)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([squeeze(gid, count)], pa.binary()), pa.array([sums[0]]), pa.array([sums[1]]), many], names=["block", "words", "known", "total", "hot"])

    for batch in batches:
        for k in range(batch.num_rows):
            block, words, known, total = (c[k].as_py() for c in batch.columns)
            if block != now and held:
                yield out()
                held.clear()
                sums = [0, 0]
            now = block
            held.append(spread(words))
            sums = [sums[0] + known, sums[1] + total]
    if held:
        yield out()


PAIRS = "class int, block bigint, pairs binary"


def hot_pairs(ids: np.ndarray, begin: np.ndarray, gid: np.ndarray, count: np.ndarray, hot: int, classes: int) -> tuple[np.ndarray, ...]:
    """(at, pair, first, second, class): the symbols of a block that follow a hot word, which pair each is, and the pairs' words in order of their classes."""
    last = np.empty(len(ids), dtype=np.int64)
    last[1:] = ids[:-1]
    last[begin] = -1
    at = np.flatnonzero((last >= 0) & (count[last] > hot))
    code, pair = np.unique(last[at] * len(gid) + ids[at], return_inverse=True)
    first, second = np.divmod(code, len(gid))
    kind = (mix(mix(gid[first]) + gid[second]) % np.uint64(classes)).astype(np.int64)
    order = np.lexsort((gid[second], gid[first], kind))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return at, place[pair], first[order], second[order], kind[order]


def _hot_pairs(batches: Iterator[pa.RecordBatch], hot: int, classes: int) -> Iterator[pa.RecordBatch]:
    """Blocks -> by class, the pairs of a hot word and what follows it, each with its training count and the second word's."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, docs, packed, words = (c[row].as_py() for c in batch.columns)
            _, _, held, length = spread(docs)
            ids, place = (x.astype(np.int64) for x in spread(packed))
            gid, count = (x[place] for x in spread(words))
            length = length.astype(np.int64)
            at, pair, first, second, kind = hot_pairs(ids, np.cumsum(length) - length, gid, count, hot, classes)
            if not len(at):
                continue
            seen = np.bincount(pair, weights=np.repeat(held == 0, length)[at], minlength=len(first)).astype(np.int64)
            edges = np.flatnonzero(np.diff(kind, prepend=-1))
            made = [squeeze(gid[first[a:b]], gid[second[a:b]], count[second[a:b]], seen[a:b]) for a, b in zip(edges, [*edges[1:], len(kind)])]
            yield pa.RecordBatch.from_arrays([pa.array(kind[edges], pa.int32()), pa.array(np.full(len(edges), block)), pa.array(made, pa.binary())], names=["class", "block", "pairs"])


COUNTED = "block bigint, class int, counts binary, word bigint, kinds bigint, n bigint, followers binary"


def _hot_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by class -> for each block the counts of its pairs over all blocks, and for each hot word its part of the one-word context."""
    now, held = None, []
    schema = pa.schema([("block", pa.int64()), ("class", pa.int32()), ("counts", pa.binary()), ("word", pa.int64()), ("kinds", pa.int64()), ("n", pa.int64()), ("followers", pa.binary())])

    def out() -> Iterator[pa.RecordBatch]:
        parts = [spread(x) for _, x in held]
        word, symbol, count, seen = (np.concatenate(x) for x in zip(*parts))
        _, first, pair = np.unique(mix(mix(word) + symbol), return_index=True, return_inverse=True)
        total = np.bincount(pair, weights=seen).astype(np.int64)
        ends = np.cumsum([len(x[0]) for x in parts])
        back, size = [squeeze(x) for x in np.split(total[pair], ends[:-1])], len(held)
        none = lambda kind: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held]), pa.array([now] * size, pa.int32()), pa.array(back, pa.binary()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary())], schema=schema)
        some = np.flatnonzero(total)
        some = some[np.argsort(word[first[some]], kind="stable")]
        word, count, total = word[first[some]], count[first[some]], total[some]
        edges = np.flatnonzero(np.diff(word, prepend=np.uint64(0)))  # no number is 0
        spans = list(zip(edges, [*edges[1:], len(word)]))
        size = len(spans)
        yield pa.RecordBatch.from_arrays(
            [none(pa.int64()), none(pa.int32()), none(pa.binary()), pa.array(word[edges].astype(np.int64)), pa.array([int(b - a) for a, b in spans], pa.int64()),
             pa.array([int(total[a:b].sum()) for a, b in spans], pa.int64()), pa.array([squeeze(total[a:b], count[a:b]) for a, b in spans], pa.binary())], schema=schema
        )

    for batch in batches:
        for kind, block, pairs in zip(*(c.to_pylist() for c in batch.columns)):
            if kind != now and held:
                yield from out()
                held.clear()
            now = kind
            held.append((block, pairs))
    if held:
        yield from out()


def _hot_gains(batches: Iterator[pa.RecordBatch], norm: float) -> Iterator[pa.RecordBatch]:
    """(word, d, n, followers) -> what its part of the one-word context gains over the root, as in `branch`."""
    for batch in batches:
        gains = []
        for d, n, followers in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            a, count = (x.astype(np.float64) for x in spread(followers))
            root = (count + ALPHA) / norm
            gains.append(float((a * np.log((a - 1 + d * root) / (n - 1 + d) / root)).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gains, pa.float64())], names=["word", "d", "gain"])


def with_hot(blocks: DataFrame, packed: DataFrame, norm: float, hot: int, classes: int, divergence: float) -> DataFrame:
    """`blocks` with the counts of their hot pairs, by class, and the kept hot words with their distinct followers."""
    rows = blocks.mapInArrow(lambda b: _hot_pairs(b, hot, classes), PAIRS).repartitionById(classes, F.col("class")).sortWithinPartitions("class", "block")
    counted = rows.mapInArrow(_hot_counted, COUNTED)
    back = counted.where("block IS NOT NULL").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "counts"))), lambda x: x["counts"]).alias("pair_counts"))
    one = Window.partitionBy("word")
    parts = counted.where("word IS NOT NULL").select("word", F.sum("kinds").over(one).alias("d"), F.sum("n").over(one).alias("n"), "followers")
    heads = parts.mapInArrow(lambda b: _hot_gains(b, norm), "word bigint, d bigint, gain double").groupBy("word").agg(F.first("d").alias("d"), F.sum("gain").alias("gain")).where(F.col("gain") >= divergence)
    mine = packed.select("block", F.explode("hot").alias("word")).join(heads.select("word", "d"), "word").groupBy("block").agg(F.collect_list(F.struct("word", "d")).alias("heads"))
    return blocks.join(back, "block", "left").join(mine, "block", "left").select("block", "docs", "symbols", "words", "pair_counts", "heads")


PIECES = "branch bigint, block bigint, docs binary, piece binary"


def _pieces(batches: Iterator[pa.RecordBatch], norm: float, branches: int, depth: int, least: int, hot: int, pair_classes: int, slice_symbols: int) -> Iterator[pa.RecordBatch]:
    """Of each block: a row of sums per document, and for each task of branches the symbols that go there."""
    schema = pa.schema([("branch", pa.int64()), ("block", pa.int64()), ("docs", pa.binary()), ("piece", pa.binary())])

    def rows(branch: list, block: int, docs: list, piece: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(branch, pa.int64()), pa.array([block] * len(branch), pa.int64()), pa.array(docs, pa.binary()), pa.array(piece, pa.binary())], schema=schema)

    for batch in batches:
        for row in range(batch.num_rows):
            block, docs, packed, words, pair_counts, heads = (c[row].as_py() for c in batch.columns)
            key, none, held, length = spread(docs)
            ids, place = (x.astype(np.int32) for x in spread(packed))
            gid, count = (x[place] for x in spread(words))
            length = length.astype(np.int64)
            begin = np.cumsum(length) - length
            base = np.add.reduceat(np.log10(count + ALPHA)[ids], begin) - length * np.log10(norm)
            n_known = np.add.reduceat((count > 0)[ids].astype(np.int64), begin)
            yield rows([int(block) % branches], block, [struct.pack("<Q", len(base)) + base.tobytes() + squeeze(key, none, held, length, n_known)], [None])
            classes = -(-count.astype(np.int64) // hot)
            distinct = np.zeros(len(gid), dtype=np.int64)  # followers of the hot words whose context is kept
            if heads:
                numbers = np.argsort(gid)
                distinct[numbers[np.searchsorted(gid, [h["word"] for h in heads], sorter=numbers)]] = [h["d"] for h in heads]
            follows = np.zeros(len(ids) if pair_counts else 0, dtype=np.uint32)
            if pair_counts:
                after, pair = hot_pairs(ids, begin, gid, count, hot, pair_classes)[:2]
                follows[after] = np.concatenate([spread(x)[0] for x in pair_counts])[pair]
                del after, pair
            goes = (mix(gid) % np.uint64(branches)).astype(np.int64)
            edges = np.searchsorted(begin, np.arange(0, len(ids), slice_symbols))
            for a, b in zip(edges, [*edges[1:], len(length)]):
                if a == b:
                    continue
                lo, hi = int(begin[a]), int(begin[b - 1] + length[b - 1])
                part = ids[lo:hi]
                n = len(part)
                owner = np.repeat(np.arange(a, b, dtype=np.int32), length[a:b])
                age = np.arange(lo, hi) - begin[owner]
                words_before = [np.where(age >= k, np.concatenate([np.zeros(min(k, n), dtype=np.int32), part[: max(n - k, 0)]]), np.int32(-1)) for k in range(1, depth + 1)]
                last = words_before[0]
                some = np.flatnonzero((last >= 0) & (count[last] >= least))
                last = last[some]
                of = np.zeros(len(some), dtype=np.uint64)  # class of a hot word
                many = classes[last] > 1
                if many.any():
                    second = words_before[1][some[many]] if depth > 1 else part[some[many]]
                    of[many] = mix(np.where(second >= 0, gid[second] + np.uint64(1), 0).astype(np.uint64)) % classes[last[many]].astype(np.uint64)
                full = gid[last] | (of << np.uint64(CLASS_BITS))
                to = np.where(of > 0, (mix(full) % np.uint64(branches)).astype(np.int64), goes[last])
                order = np.lexsort((full, to))
                some, full, to = some[order], full[order], to[order]
                at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
                made: tuple[list, list] = ([], [])
                for x, y in zip(at, [*at[1:], len(to)]):
                    where, keys = some[x:y], full[x:y]
                    run = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    kinds, first, which = np.unique(gid[part[where]], return_index=True, return_inverse=True)
                    others = []
                    for w in words_before[1:]:
                        v = w[where]
                        others.append(np.where((v >= 0) & (count[v] >= least), gid[v] + np.uint64(1), 0))
                    mine = words_before[0][where[run]]  # the last words themselves
                    shared = [np.where(classes[mine] > 1, count[mine], 0), np.where(classes[mine] > 1, distinct[mine], 0), follows[lo:hi][where] if len(follows) else []]
                    columns = [steps(keys[run]), np.diff([*run, len(keys)]), *shared, steps(kinds), count[part[where[first]]], which, (owner[where] << 1) | (held[owner[where]] == 0), *others]
                    made[0].append(int(to[x]))
                    made[1].append(squeeze(*columns))
                yield rows(made[0], block, [None] * len(made[0]), made[1])


SUMS = "block bigint, docs binary, places binary, gains binary"


def _branches(batches: Iterator[pa.RecordBatch], norm: float, least: int, divergence: float) -> Iterator[pa.RecordBatch]:
    """Rows by branch -> sums of log10(p / root) per block and document; rows of documents pass."""
    now, held = None, []
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("places", pa.binary()), ("gains", pa.binary())])

    def out() -> pa.RecordBatch:
        columns: list[list] = []
        for at, (block, piece) in enumerate(held):
            held[at] = (block, None)
            keys, runs, hot, distinct, follows, kinds, counts, which, owners, *others = spread(piece)
            keys, kinds, which, runs = np.cumsum(keys), np.cumsum(kinds), which.astype(np.int64), runs.astype(np.int64)
            root = (counts[which] + ALPHA) / norm
            given = np.zeros(len(root))
            if hot.any():  # at its one-word context, which other tasks share
                n, d = (np.repeat(x, runs).astype(np.float64) for x in (hot, distinct))
                given = np.where(n > 0, np.where(d > 0, (follows + d * root) / np.maximum(n + d, 1), root), 0)
            columns.append([np.repeat(keys, runs), kinds[which], root, given, owners.astype(np.uint32), *others])
        sizes = [len(x[0]) for x in columns]
        keys, symbol, root, given, owner, *before = (np.concatenate(x) for x in zip(*columns))
        columns.clear()
        gain = branch(keys, before, symbol, root, (owner & 1) == 1, least, divergence, given if given.any() else None)
        gain /= root
        np.log10(gain, out=gain)
        del keys, symbol, root, given, before
        owner = owner.astype(np.int64)
        blocks, places, sums, end = [], [], [], 0
        for (block, _), n in zip(held, sizes):
            at, g = owner[end : end + n] >> 1, gain[end : end + n]
            end += n
            low = int(at.min())
            total = np.bincount(at - low, weights=g)
            hit = np.flatnonzero(total)
            if len(hit):
                blocks.append(block)
                places.append((hit + low).astype("<u2").tobytes())
                sums.append(total[hit].astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.nulls(len(blocks), pa.binary()), pa.array(places, pa.binary()), pa.array(sums, pa.binary())], schema=schema)

    for batch in batches:
        for k in range(batch.num_rows):
            branch_, block, docs, piece = (c[k].as_py() for c in batch.columns)
            if docs is not None:
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([docs], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=schema)
                continue
            if branch_ != now and held:
                yield out()
                held.clear()
            now = branch_
            held.append((block, piece))
    if held:
        yield out()


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block -> a row per document."""
    now, docs, gains = None, None, np.zeros(BLOCK_DOCS)

    def out() -> pa.RecordBatch:
        (n,) = struct.unpack_from("<Q", docs)
        base = np.frombuffer(docs, count=n, offset=8)
        key, none, held, length, known = spread(docs[8 + 8 * n :])
        columns = [pa.array(key.view(np.int64), mask=none > 0), pa.array(held > 0), pa.array(length.view(np.int64)), pa.array(known.view(np.int64)), pa.array(base), pa.array(base + gains[:n])]
        gains[:] = 0
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for block, d, places, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now and now is not None:
                yield out()
            now = block
            if d is not None:
                docs = d
            else:
                gains[np.frombuffer(places, dtype="<u2")] += np.frombuffer(sums, dtype="<f4")
    if now is not None:
        yield out()


# ------------------------------------------------------------------------------------------ driver


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 3, least: int = 2, divergence: float = 6.0, hot: int = 500_000, branch_symbols: int = 1_000_000,
    block_symbols: int = 4_000_000, slice_symbols: int = 2_000_000,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    `score` is the log10 probability of the whole text under the tree, `base_score` under its root. A null text is
    empty: its one token is the end. A null doc_id counts as training. Repeated rows count and are scored each
    for itself. Without training documents every token has probability one at the root. An empty table gives none.
    A block ends with the document that brings it to `block_symbols` (or BLOCK_DOCS documents); its symbols are
    dealt out by `slice_symbols`; a task of branches holds about `branch_symbols`; the branch of a word counted more
    than `hot` times is split. None of these changes the result.
    """
    if depth < 1 or least < 2 or hot < least:
        raise ValueError("depth must be 1 or more, least 2 or more, hot least or more")
    narrow = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    classes = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = stored(narrow.mapInArrow(lambda b: _blocks(b, block_symbols, classes), BLOCKS), "symbols")
    words = made.where("words IS NOT NULL").select("class", "block", "words", "counts").repartition("class").sortWithinPartitions("class", "block")
    numbered = words.mapInArrow(lambda b: _numbered(b, classes), NUMBERED).repartition("block").sortWithinPartitions("block", "class").select("block", "words", "known", "total")
    packed = stored(numbered.mapInArrow(lambda b: _dictionaries(b, hot), "block bigint, words binary, known bigint, total bigint, hot array<bigint>"), "dictionaries")
    known, total, many = (x or 0 for x in packed.agg(F.sum("known"), F.sum("total"), F.sum(F.size("hot"))).first())
    norm, branches = total + ALPHA * (known + 1), max(1, -(-total // branch_symbols))
    pair_classes = max(1, branches // 4)  # what follows hot words is summed by block first

    blocks = made.where("symbols IS NOT NULL").select("block", "docs", "symbols").join(packed.select("block", "words"), "block")
    if many:
        blocks = with_hot(blocks, packed, norm, hot, pair_classes, divergence)
    else:  # nothing to share between tasks
        blocks = blocks.select("*", F.lit(None).cast("array<binary>").alias("pair_counts"), F.lit(None).cast("array<struct<word:bigint,d:bigint>>").alias("heads"))
    pieces = blocks.mapInArrow(lambda b: _pieces(b, norm, branches, depth, least, hot, pair_classes, slice_symbols), PIECES)
    sums = pieces.repartitionById(branches, F.col("branch").cast("int")).sortWithinPartitions("branch").mapInArrow(lambda b: _branches(b, norm, least, divergence), SUMS)
    out = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_documents, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
