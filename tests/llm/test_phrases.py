import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000):
    """rows: (lang, text)"""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang in f:
        c = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        inner = {p[i : i + m] for p, a in c.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= c.get(p[i : i + m], 0)}
        rows = []
        for p, a in c.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int")
    return sorted(tuple(r) for r in P.collocations(df, **more).collect())


def prose(n, seed=3, words=12):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "New", "York", "côté", "a", "in", "–", "x|y", "Ä", "b\x00c", "zz"][:words]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".\n", " ! ", " "]
    out = []
    for _ in range(n):
        w = rng.zipf(1.6, 40) % len(vocabulary)
        out.append("".join(vocabulary[i] + glue[rng.integers(len(glue))] for i in w))
    return out


@pytest.mark.parametrize("bits, shard", [(4, 400_000), (12, 40), (20, 400_000)])
def test_equals_brute_force(spark, bits, shard):
    rows = [(["en", "de", None, "und"][k % 4], t) for k, t in enumerate(prose(60))]
    got = found(spark, rows, least=6, bits=bits, shard=shard)
    assert got == brute(rows, 6) and len(got) > 20


def test_small_blocks_and_caches(spark, monkeypatch):
    rows = [("en", t) for t in prose(40, seed=5)]
    want = brute(rows, 5)
    for name, value in (("BLOCK_BYTES", 300), ("MOST_WORDS", 5), ("MOST_HASHES", 50)):
        monkeypatch.setattr(P, name, value)
    texts = [(lang, t.encode()) for lang, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([x for _, x in texts])], names=["lang", "text"])
    made = list(P._count(iter([batch]), {}, range(1, 3), 20))
    total = sum(x for b in made for k, x in zip(b.column(0).to_pylist(), b.column(5).to_pylist()) if k == 0)
    assert total == want[0][6]
    assert found(spark, rows, least=5) == want


def test_overlaps_ties_and_copies(spark):
    rows = [("en", "a a a a a a a a"), ("en", "b c d b c d"), ("en", "b c d b c d")] * 3 + [("fr", "x y, x y; x: y x y")] * 4
    assert found(spark, rows, least=4) == brute(rows, 4)
    assert found(spark, rows, least=4, top=1) == brute(rows, 4, top=1)


def test_empty_null_and_long(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, ""), (None, " .,;\n"), ("en", "one two")], least=2) == []
    rows = [("en", "pair of words " * 5000), (None, "w" * 200_000 + " end")]
    assert found(spark, rows, least=100) == brute(rows, 100)


def test_trie_holds_just_its_phrases():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    listed = sorted({(["en", "de"][rng.integers(2)], " ".join(rng.choice(words, rng.integers(1, 6)))) for _ in range(3000)} | {("en", f"w0 {w}") for w in words})
    trie = P.build(listed)
    at = {lang: [p.split(" ") for x, p in listed if x == lang] for lang in ("en", "de")}
    for lang, held in at.items():
        data = b" . ".join(" ".join(p).encode() for p in held) + b" w0 unknown w1"
        w = P.Words()
        ids = w.numbers(data)
        sums = trie.count(ids, w.texts, lang)
        mine = {tuple(p) for p in held}
        want = Counter()
        for p in [*held, ["w0", "unknown", "w1"]]:
            for k in range(1, 6):
                for i in range(len(p) - k + 1):
                    if tuple(p[i : i + k]) in mine:
                        want[" ".join(p[i : i + k])] += 1
        hit = np.flatnonzero((sums > 0) & (trie.phrase >= 0))
        assert {listed[trie.phrase[s]][1]: int(sums[s]) for s in hit} == want
        assert all(listed[trie.phrase[s]][0] == lang for s in hit)
