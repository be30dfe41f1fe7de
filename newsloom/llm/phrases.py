"""Phrase collocations per language, counted by broadcast double-array tries of Apriori-safe candidates.

A phrase of k words can only occur `least` times if its words and all shorter phrases in it do. Three passes over the
texts make candidates that are safe by that rule:

1. words and pairs of neighbouring words are counted by hash in tables of fixed size; what falls into a bucket below
   `least` is out for good (two phrases in a bucket only let more through);
2. windows of three to five words all of whose pairs are still in are counted in the same way;
3. windows that passed at all lengths become candidates, made distinct in Spark.

Candidates stand in double-array tries (a language, then two digits a word, so a node has few children in a
small range). A trie holds `shard` candidates at most, so what is broadcast has a bound; more candidates take more tries and
a pass each. In a pass numpy advances the states of all positions of a block of texts at once, level by level, and
bincounts the accepting states; the counts of all tasks are added up. These counts are exact, whatever the
buckets let through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import fresh_dir, spread_join

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that are worked on together; one longer text is worked on whole.
BLOCK_BYTES = 8 << 20
#: Distinct words that a task numbers before it starts anew; hashes that it gathers before it sends counts.
MOST_WORDS, MOST_HASHES = 1 << 19, 1 << 22
#: Buckets a row of counts covers, as a power of two.
CHUNK_BITS = 16
SHARD, CHUNK = 400_000, 1 << 10
_BREAK = b"."
_TABLE = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == ord("\t") else c for c in range(256))


class Words(dict):
    """Numbers words by first appearance; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self._hashes, self._known = np.zeros(1024, dtype=np.uint64), 0
        self.texts: list[bytes] = [_BREAK]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.texts.append(word)
        return n

    def numbers(self, data: bytes) -> np.ndarray:
        tokens = data.lower().translate(_TABLE).replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word so far."""
        known, n = self._known, len(self)
        if n > len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros(max(n, len(self._hashes)), dtype=np.uint64)])
        digest = xxhash.xxh64_intdigest
        self._hashes[known:n] = np.fromiter(map(digest, self.texts[known:n]), dtype=np.uint64, count=n - known)
        self._known = n
        return self._hashes[:n]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts of it end to end) of batches (lang, text as bytes)."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py()
            if data:
                held.setdefault(lang, []).append(data)
                size += len(data)
            if size >= BLOCK_BYTES:
                yield from ((k, _BREAK.join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, _BREAK.join(v)) for k, v in held.items())


def _step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15) + word
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def windows(ids: np.ndarray, words: np.ndarray, lang: str, filters: dict[int, np.ndarray], most: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, buckets): the windows of k words inside a piece that hold no shorter one that a filter rules out, nor fail their own."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    word = words[ids]
    h, alive = np.full(len(ids), seed), ids > 0
    for k in range(1, most + 1):
        if k > 1:
            alive = alive[:-1] & alive[1:]
        at = np.flatnonzero(alive)
        h[at] = _step(h[at], word[at + (k - 1)])
        bucket = (h[at] >> np.uint64(64 - bits)).astype(np.int64)
        if k in filters:
            passed = (filters[k][bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 > 0
            at, bucket = at[passed], bucket[passed]
            alive = np.zeros(len(alive), dtype=bool)
            alive[at] = True
        yield k, at, bucket


COUNTS = "level int, chunk int, lang string, ids binary, counts binary, n bigint"


def _count(batches: Iterator[pa.RecordBatch], filters: dict[int, np.ndarray], levels: range, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of bucket counts by level and chunk, and (level 0) of words per language."""
    words, held, total = Words(), {k: [] for k in levels}, {}
    schema = pa.schema([("level", pa.int32()), ("chunk", pa.int32()), ("lang", pa.string()), ("ids", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])

    def out() -> Iterator[pa.RecordBatch]:
        for k in levels:
            if not held[k]:
                continue
            bucket, n = np.unique(np.concatenate(held[k]), return_counts=True)
            held[k].clear()
            chunk, low = bucket >> CHUNK_BITS, (bucket & ((1 << CHUNK_BITS) - 1)).astype("<u2")
            kinds, at = np.unique(chunk, return_index=True)
            parts = list(zip(at, [*at[1:], len(bucket)]))
            ids, counts = [low[a:b].tobytes() for a, b in parts], [n[a:b].astype("<u4").tobytes() for a, b in parts]
            m = len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array(kinds, pa.int32()), pa.nulls(m, pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(m, pa.int64())], schema=schema)

    for lang, data in blocks(batches):
        ids = words.numbers(data)
        if 1 in levels:
            total[lang] = total.get(lang, 0) + int(np.count_nonzero(ids))
        for k, _, bucket in windows(ids, words.hashes(), lang, filters, max(levels), bits):
            if k in levels and len(bucket):
                held[k].append(bucket.astype(np.uint32))
        if max(sum(map(len, x)) for x in held.values()) >= MOST_HASHES:
            yield from out()
        if len(words) > MOST_WORDS:
            words = Words()
    yield from out()
    m = len(total)
    yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.nulls(m, pa.int32()), pa.array(list(total), pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(list(total.values()), pa.int64())], schema=schema)


def _often(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of counts sorted by level and chunk -> a bit per bucket that reaches `least`; rows of languages pass."""
    now, sums = None, np.zeros(1 << CHUNK_BITS, dtype=np.int64)

    def out() -> pa.RecordBatch:
        packed = np.packbits(sums >= least, bitorder="little").tobytes()
        sums[:] = 0
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.nulls(1, pa.string()), pa.array([packed], pa.binary()), pa.nulls(1, pa.int64())], names=["level", "chunk", "lang", "often", "n"])

    for batch in batches:
        for row in range(batch.num_rows):
            level, chunk, lang, ids, counts, n = (c[row].as_py() for c in batch.columns)
            if level == 0:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int32()), pa.array([lang], pa.string()), pa.nulls(1, pa.binary()), pa.array([n], pa.int64())], names=["level", "chunk", "lang", "often", "n"])
                continue
            if (level, chunk) != now and now:
                yield out()
            now = level, chunk
            sums[np.frombuffer(ids, dtype="<u2")] += np.frombuffer(counts, dtype="<u4")  # ids of a row are distinct
    if now:
        yield out()


def _filters(texts: DataFrame, known: dict[int, np.ndarray], levels: range, bits: int, least: int, folder: str) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Bits of the frequent buckets by level, of 2 ** bits each, and the words of each language."""
    shared = texts.sparkSession.sparkContext.broadcast(known)
    made = texts.mapInArrow(lambda b: _count(b, shared.value, levels, bits), COUNTS)
    made = made.repartition("level", "chunk", "lang").sortWithinPartitions("level", "chunk")
    path = f"{folder}/buckets-{min(levels)}"
    made.mapInArrow(lambda b: _often(b, least), "level int, chunk int, lang string, often binary, n bigint").write.parquet(path)
    found = texts.sparkSession.read.schema("level int, chunk int, lang string, often binary, n bigint").parquet(path)
    out = {k: np.zeros(1 << max(0, bits - 3), dtype=np.uint8) for k in levels}
    width = 1 << (CHUNK_BITS - 3)
    for level, chunk, often in found.where("level > 0").select("level", "chunk", "often").toLocalIterator():
        out[level][chunk * width : (chunk + 1) * width] = np.frombuffer(often, dtype=np.uint8)[: len(out[level])]
    return out, found.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _candidates(batches: Iterator[pa.RecordBatch], filters: dict[int, np.ndarray], longest: int, bits: int, chunks: int) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, phrases) of windows that pass at all lengths, words among them: the distinct ones of many texts, dealt to chunks by hash."""
    words, seen, fresh = Words(), set(), {}

    def out() -> pa.RecordBatch:
        rows = [(c, lang, b"\n".join(sorted(p))) for (c, lang), p in fresh.items()]
        fresh.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.string(), pa.binary()))], names=["chunk", "lang", "phrases"])

    for lang, data in blocks(batches):
        ids = words.numbers(data)
        rank = np.zeros(len(ids), dtype=np.int64)
        for k, at, _ in windows(ids, words.hashes(), lang, filters, longest, bits):
            if not len(at):
                break
            code = (rank[at] << 32) | ids[at + (k - 1)]
            first, inverse = np.unique(code, return_index=True, return_inverse=True)[1:]
            rank[at] = inverse  # tells windows of k words apart
            for i in at[first].tolist():
                phrase = b" ".join([words.texts[w] for w in ids[i : i + k].tolist()])
                if (lang, phrase) not in seen:
                    seen.add((lang, phrase))
                    fresh.setdefault((zlib.crc32(phrase) % chunks, lang), []).append(phrase)
        if len(words) > MOST_WORDS:
            words = Words()
        if len(seen) > MOST_WORDS:
            yield out()
            seen.clear()
    yield out()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk and language -> (lang, phrase), each once."""
    now, held = None, set()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(held), pa.string()), pa.array(sorted(held), pa.binary()).cast(pa.string())], names=["lang", "phrase"])

    for batch in batches:
        for row in range(batch.num_rows):
            chunk, lang, phrases = (c[row].as_py() for c in batch.columns)
            if (chunk, lang) != now and held:
                yield out()
                held = set()
            now = chunk, lang
            held.update(phrases.split(b"\n"))
    if held:
        yield out()


# ------------------------------------------------------------------------------------------ the trie


@dataclass
class Trie:
    """A double array: the child of state s by digit d is t = base[s] + d if check[t] = s."""

    langs: dict[str, int]  # states
    codes: dict[bytes, int]
    digit: int  # a word is two digits below this
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray  # the number of the phrase that a state accepts, or -1
    longest: int

    def count(self, ids: np.ndarray, texts: list[bytes], lang: str) -> np.ndarray:
        """Occurrences per state in numbered words."""
        root = self.langs.get(lang)
        if root is None or not len(ids):
            return np.zeros(len(self.base), dtype=np.int64)
        code = np.fromiter((self.codes.get(w, -1) for w in texts), dtype=np.int64, count=len(texts))[ids]
        at, state, ends = np.arange(len(ids)), np.full(len(ids), root, dtype=np.int64), []
        for k in range(self.longest):
            inside = at + k < len(ids)
            at, state = at[inside], state[inside]
            word = code[at + k]
            here = word >= 0
            at, state, word = at[here], state[here], word[here]
            for low in (False, True):
                to = self.base[state] + (word % self.digit if low else word // self.digit)
                here = (to >= 0) & (to < len(self.check))
                here[here] = self.check[to[here]] == state[here]
                at, state, word = at[here], to[here], word[here]
            ends.append(state)
            if not len(at):
                break
        return np.bincount(np.concatenate(ends), minlength=len(self.base))


def build(phrases: list[tuple[str, str]], seed: int = 5) -> Trie:
    """The trie of distinct (lang, phrase)."""
    split = [p.encode().split(b" ") for _, p in phrases]
    codes = {w: k for k, w in enumerate(sorted({w for p in split for w in p}))}
    langs = {x: k for k, x in enumerate(sorted({x for x, _ in phrases}))}
    digit, longest = max(1, int(np.ceil(np.sqrt(len(codes))))), max(map(len, split), default=0)
    table = np.full((len(phrases), longest), -1, dtype=np.int64)
    for k, p in enumerate(split):
        table[k, : len(p)] = [codes[w] for w in p]
    # Nodes level by level: (parent, digit) pairs, numbered behind the languages.
    node = np.array([langs[x] for x, _ in phrases], dtype=np.int64)
    parents, digits, nodes, phrase = [], [], len(langs), np.full(len(phrases), -1, dtype=np.int64)
    for k in range(longest):
        on = np.flatnonzero(table[:, k] >= 0)
        for d in (table[on, k] // digit, table[on, k] % digit):
            pair, inverse = np.unique(node[on] * digit + d, return_inverse=True)
            parents.append(pair // digit)
            digits.append(pair % digit)
            node[on] = nodes + inverse
            nodes += len(pair)
        phrase[on] = node[on]  # the last word's node stays
    if not parents:
        return Trie({}, codes, digit, np.zeros(1, np.int64), np.full(1, -1), np.full(1, -1), 0)
    parent, by = np.concatenate(parents), np.concatenate(digits)
    child = np.arange(len(langs), nodes)
    # Places: languages first, then nodes with many children each in a stretch of their own, then the others in gaps.
    order = np.argsort(parent, kind="stable")
    kinds, first, n = np.unique(parent[order], return_index=True, return_counts=True)
    size = 4 * nodes + 2 * digit + len(langs)
    size += int(digit * np.count_nonzero(n >= 32))
    taken = np.zeros(size, dtype=bool)
    taken[: len(langs)] = True
    place, base = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    place[: len(langs)] = np.arange(len(langs))
    rng, edge = np.random.default_rng(seed), len(langs)
    for k in np.argsort(-n, kind="stable"):
        if n[k] == 1:
            break
        mine = order[first[k] : first[k] + n[k]]
        d = by[mine]
        if n[k] >= 32:
            at = edge - int(d.min())
            edge += int(d.max() - d.min()) + 1
        else:
            while True:
                tries = rng.integers(-int(d.min()), size - int(d.max()), 16)
                free = np.flatnonzero(~taken[tries[:, None] + d[None]].any(axis=1))
                if len(free):
                    at = int(tries[free[0]])
                    break
        base[kinds[k]] = at
        place[child[mine]] = at + d
        taken[at + d] = True
    single = order[first[n == 1]]
    gaps = np.flatnonzero(~taken)[: len(single)]
    base[parent[single]] = gaps - by[single]
    place[child[single]] = gaps
    bases, check, accepts = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    bases[place] = base
    check[place[child]] = place[parent]
    accepts[place[phrase]] = np.arange(len(phrases))
    return Trie(langs, codes, digit, bases, check, accepts, longest)


def _occurrences(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[pa.RecordBatch]:
    """(chunk, ids, counts): the counts of a task, packed by runs of CHUNK phrases."""
    words, sums = Words(), np.zeros(len(trie.base), dtype=np.int64)
    for lang, data in blocks(batches):
        ids = words.numbers(data)
        sums += trie.count(ids, words.texts, lang)
        if len(words) > MOST_WORDS:
            words = Words()
    hit = np.flatnonzero((sums > 0) & (trie.phrase >= 0))
    hit = hit[np.argsort(trie.phrase[hit])]
    phrase, n = trie.phrase[hit], sums[hit]
    kinds, at = np.unique(phrase // CHUNK, return_index=True)
    parts = list(zip(at, [*at[1:], len(hit)]))
    ids, counts = [(phrase[a:b] % CHUNK).astype("<u2").tobytes() for a, b in parts], [n[a:b].astype("<u8").tobytes() for a, b in parts]
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "ids", "counts"])


def _summed(batches: Iterator[pa.RecordBatch], phrases: list[tuple[str, str]], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk -> (lang, phrase, f) of what reaches `least`."""
    now, sums = None, np.zeros(CHUNK, dtype=np.int64)

    def out() -> pa.RecordBatch:
        hit = np.flatnonzero(sums >= least)
        rows, f = [phrases[now * CHUNK + k] for k in hit.tolist()], sums[hit]
        sums[:] = 0
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()), pa.array(f)], names=["lang", "phrase", "f"])

    for batch in batches:
        for row in range(batch.num_rows):
            chunk, ids, counts = (c[row].as_py() for c in batch.columns)
            if chunk != now and now is not None:
                yield out()
            now = chunk
            sums[np.frombuffer(ids, dtype="<u2")] += np.frombuffer(counts, dtype="<i8")
    if now is not None:
        yield out()


def frequent(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of words and phrases (lang, text as bytes) that occur `least` times or more, and (lang, n) of words in all."""
    spark = texts.sparkSession
    folder = fresh_dir(spark, "phrases")
    if bits is None:
        # About eight words' bytes a bucket, and bitmaps of 128 MB at most; beyond that more candidates pass, no count changes.
        size = texts.agg(F.coalesce(F.sum(F.length("text").cast("double")), F.lit(0.0))).first()[0]
        bits = min(30, max(20, int(np.ceil(np.log2(size / 48 + 1)))))
    filters, n = _filters(texts, {}, range(1, 3), bits, least, folder)
    if longest > 2:
        filters |= _filters(texts, filters, range(3, longest + 1), bits, least, folder)[0]
    shared = spark.sparkContext.broadcast(filters)  # 2 ** bits bits a length
    chunks = 1 << (bits - min(bits, CHUNK_BITS))
    made = texts.mapInArrow(lambda b: _candidates(b, shared.value, longest, bits, chunks), "chunk int, lang string, phrases binary")
    made = made.repartition("chunk", "lang").sortWithinPartitions("chunk", "lang").mapInArrow(_distinct, "lang string, phrase string")
    made.write.parquet(f"{folder}/candidates")
    candidates = spark.read.schema("lang string, phrase string").parquet(f"{folder}/candidates")
    tries, parts = max(1, -(-candidates.count() * 5 // (4 * shard))), []
    for k in range(tries):
        mine = candidates.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(tries)) == k).orderBy("lang", "phrase").collect()  # about 4/5 of `shard` rows
        mine = [tuple(r) for r in mine]
        trie, listed = spark.sparkContext.broadcast(build(mine)), spark.sparkContext.broadcast(mine)
        counts = texts.mapInArrow(lambda b, trie=trie: _occurrences(b, trie.value), "chunk int, ids binary, counts binary")
        counts = counts.repartition("chunk").sortWithinPartitions("chunk")
        counts.mapInArrow(lambda b, listed=listed: _summed(b, listed.value, least), "lang string, phrase string, f bigint").write.parquet(f"{folder}/counts/{k}")
        parts.append(spark.read.schema("lang string, phrase string, f bigint").parquet(f"{folder}/counts/{k}"))
        trie.unpersist()
        listed.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, n


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, **more) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at .,;:!? and line ends, pieces into words at blanks and tabs. A phrase
    of two words or more that occurs a >= `least` times is cut where floor(1000 a n / (l r)) is least (ties: the first
    cut); l and r count its parts, n all words of the language. Dropped is what occurs inside a longer one each time. A
    null text is empty, a null language is `und`; repeated rows count each; an empty table gives no row.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    f, n = frequent(texts, least, longest, **more)
    words = F.split("phrase", " ")
    c = f.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = c.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    # A frequent word is the part of many phrases: its rows go to several tasks.
    part = lambda name, count: f.select(F.struct("lang", "phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct("lang", F.col("first").alias("phrase")).alias("p"), F.struct("lang", F.col("rest").alias("phrase")).alias("q"))
    cuts = spread_join(spread_join(spread_join(cuts, part("p", "l"), "p"), part("q", "r"), "q"), n, "lang")
    cuts = cuts.withColumns({"x": F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)"), "y": F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")})
    cuts = cuts.withColumn("score", F.expr("x div y"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*").drop("k")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inner = c.where(F.size("w") > 2).select("lang", "a", F.explode(runs).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = scored.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same phrases from all windows of all texts.
ORACLE_SQL = f"""WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM i, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1 :], ' ') JOIN n ON n.lang = c.lang),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(ws[x : x + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k)) AS x FROM c), (SELECT unnest(range(2, {LONGEST})) AS m) WHERE m < k AND x + m - 1 <= k GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score FROM scored s
LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= {TOP}"""
