import random

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash as S
from newsloom.llm.graph import connected_components


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, bits=4):
    """items: [(doc_id, fp)] -> {doc_id: component}"""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(items):
        r = find(k)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(k)] for k, (d, _) in enumerate(items)}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b  c\td", "x " * 30, "Ünï Çode a b c d e f", "a b c d e f g " * 50])
def test_fingerprint(text):
    assert S.simhash(text) == brute_fp(text)


def test_trie_links_against_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = set()
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fp.add(x)
    fp = np.sort(np.array(list(fp), dtype=np.uint64))
    for chunk in (7, 1 << 17):
        label = S.trie_links(fp, fp, np.array([0]), [(0, len(fp))], np.full(len(fp), 2), 4, leaf=4, chunk=chunk)
        want = brute_components([(i, int(x)) for i, x in enumerate(fp)])
        assert label.tolist() == [want[i] for i in range(len(fp))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 1 for i in range(2, 61)} | {k: 100 for k in range(101, 150)} | {200: 199}
    assert {v: r for v, r in got.items() if v != r} == want


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "two words")]
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        for k in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((100 * g + k + 10, " ".join(copy)))
    return rows


@pytest.mark.parametrize("max_group", [20_000, 3])
def test_near_duplicates_equal_brute_force(spark, rows, max_group, monkeypatch):
    monkeypatch.setattr(S.hamming_components, "__defaults__", (4, 6, max_group))
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, fingerprint_bits string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    comp = brute_components(fps)
    assert got == {i: (f"{fp:016x}", comp[i]) for i, fp in fps}


def test_drop_keeps_one_of_each_group_and_all_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, "z") for i, t in [*rows, rows[7]]], "doc_id long, text string, _gone string")
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    comp = brute_components([(i, brute_fp(t)) for i, t in rows])
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for c in comp.values()})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []
    assert S.drop_near_duplicates(docs).collect() == []
