import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import suffix_tree as S

DEPTH, LEAST, DIVERGENCE = 4, 2, 6.0


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def corpus():
    rnd = random.Random(6)
    rare = [f"r{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, "The END of it"), (3, "É Ö ß  x\ty"), (3, "É Ö ß  x\ty")]
    for i in range(10, 400):
        out = []
        for _ in range(rnd.randint(1, 60)):
            out += rnd.choice([["The", "old", "man"], ["of", "the"], [rnd.choice(rare)], [rnd.choice("abcdef")]])
        if i % 3 == 0:
            out += "all rights reserved by the old man".split()
        if i % 8 == 1:  # only four words of context tell the fifth
            out += rnd.choice(["left a b c left", "right a b c right"]).split()
        rows.append((i, " ".join(out)))
    return rows


def brute(rows):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(train[w] > 0 for w in tokens), n, round(base, 6)))
    return sorted(out, key=str)


def brute_scores(rows):
    """The tree by its definition: contexts as word tuples, counted in dictionaries, one level after the other."""
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*words(t), None])
    norm = sum(train.values()) + 0.1 * (len(train) + 1)
    texts = [(i, [*words(t), None], zlib.crc32(str(i).encode()) % 10 != 0) for i, t in rows]
    kept = {}

    def chain(before, s):
        p = (train[s] + 0.1) / norm
        for k in range(1, DEPTH + 1):
            node = kept.get(tuple(before[-k:])) if len(before) >= k else None
            if node:
                p = (node[s] + len(node) * p) / (sum(node.values()) + len(node))
        return p

    for k in range(1, DEPTH + 1):
        nodes, gain = {}, Counter()
        for _, w, mine in texts:
            for at in range(k, len(w) if mine else 0):
                nodes.setdefault(tuple(w[at - k : at]), Counter())[w[at]] += 1
        for c, node in nodes.items():
            n, d = sum(node.values()), len(node)
            if n >= LEAST:
                gain[c] = sum(m * math.log((m - 1 + d * chain(c, s)) / (n - 1 + d) / chain(c, s)) for s, m in node.items())
        kept |= {c: nodes[c] for c, g in gain.items() if g >= DIVERGENCE}
    scores = [(i, sum(math.log10(chain(w[:at], w[at])) for at in range(len(w)))) for i, w, _ in texts]
    return scores, kept, train, norm, chain


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in corpus()], "doc_id long, text string, row int, word string")
    return S.score(docs.repartition(3), depth=DEPTH, least=LEAST, divergence=DIVERGENCE, branch_symbols=500).collect()


def test_base_equals_brute_force(scored):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored]
    assert sorted(got, key=str) == brute(corpus())


def test_score_equals_brute_force_tree(scored):
    want, kept, *_ = brute_scores(corpus())
    assert {len(c) for c in kept} == {1, 2, 3, 4} and ("left", "a", "b", "c") in kept
    got = sorted((r.doc_id, r.score) for r in scored)
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted(want)], abs=1e-4)


def test_contexts_help_held_out_texts(scored):
    held = [r for r in scored if r.held_out and r.n_tokens > 5]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + len(held)
    assert all(r.score <= 0 for r in scored)


def test_every_state_is_a_distribution():
    """After each context, the probabilities of all words, the end and the unknown word sum to one."""
    rnd = random.Random(2)
    text = [rnd.choice([1, 2, 3, 4, 5]) if rnd.random() < 0.5 else 1 + k % 5 for k in range(400)]
    probes = [(a, b, s) for a in range(1, 6) for b in range(1, 6) for s in range(1, 7)]  # 6 is unknown
    key = np.array([*text[1:-1], *(a for a, _, _ in probes)], dtype=np.uint64)
    before = np.array([*text[:-2], *(b for _, b, _ in probes)], dtype=np.uint64)
    symbol = np.array([*text[2:], *(s for _, _, s in probes)], dtype=np.uint64)
    counts = np.bincount(text, minlength=7)
    p0 = (counts[symbol.astype(int)] + 0.1) / (len(text) + 0.1 * 6)
    train = np.arange(len(key)) < len(text) - 2
    p = S.branch(key, [before], symbol, p0, train, 2, 3.0)[len(text) - 2 :]
    assert p.reshape(25, 6).sum(axis=1) == pytest.approx(np.ones(25)) and (np.abs(p - p0[len(text) - 2 :]) > 0.01).any()


def test_branches_of_hot_words_and_small_blocks(spark, scored):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(1)
    small = {"depth": DEPTH, "least": LEAST, "divergence": DIVERGENCE, "branch_symbols": 300, "block_symbols": 700, "slice_symbols": 150}
    same = sorted((r.doc_id, r.score) for r in S.score(docs, **small).collect())
    assert [x for _, x in same] == pytest.approx([x for _, x in sorted((r.doc_id, r.score) for r in scored)], abs=1e-4)
    want = sorted(brute_scores(corpus())[0])
    for hot in (100, 20, 2):  # the least leaves no word that is counted more than twice whole
        split = sorted((r.doc_id, r.score) for r in S.score(docs.repartition(3), **{**small, "hot": hot}).collect())
        assert [i for i, _ in split] == [i for i, _ in want]
        assert [x for _, x in split] == pytest.approx([x for _, x in want], abs=1e-4)


def test_long_text_null_id_and_repeated_rows(spark):
    rows = [(None, "a b c " * 5000), (1, "x"), (1, "x"), (2, None)]
    got = sorted(((r.doc_id, r.n_tokens, r.train_tokens) for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 2, 15006), (1, 2, 15006), (2, 1, 15006), (None, 15001, 15006)]


def test_columns_come_back():
    for columns in ([np.array([], dtype=np.uint64)], [np.array([0, 5, 2**63 + 1], dtype=np.uint64), np.array([255, 256])], [np.array([0])]):
        assert [c.tolist() for c in S.spread(S.squeeze(*columns))] == [c.tolist() for c in columns]


def test_empty_and_no_training(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.score(docs).collect() == []
    alone = next(i for i in range(100) if S.is_held_out(i))
    (r,) = S.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and r.base_score == pytest.approx(0)
