import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from newsloom.llm import packing as K


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_place_every_item_once(seed):
    rng = np.random.default_rng(seed)
    units = 64
    counts = rng.integers(0, 40, units) * (rng.random(units) < (0.2 if seed % 2 else 0.9))
    out = K.cutting_patterns(counts, units)
    lengths = np.arange(1, units + 1)
    assert (sum(p * t for p, t in out) == counts).all()
    assert all((p * lengths).sum() <= units for p, t in out)
    used, least = sum(t for _, t in out), -(-int((counts * lengths).sum()) // units)
    greedy = sum(t for _, t, _ in K._first_fit(counts, units))
    assert used <= (greedy * 1.02 + 2 if seed % 2 else least * 1.05 + 4)


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(0)
    for _ in range(20):
        duals = rng.random(12) * np.arange(1, 13) / 12
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max(best[c - 1], *(best[c - k] + duals[k - 1] for k in range(1, c + 1)))
        value, pattern = K.price(duals, 12)
        assert value == pytest.approx(best[12]) and (pattern * np.arange(1, 13)).sum() <= 12
        assert (pattern * duals).sum() == pytest.approx(value)


def test_pack_round_trip(spark):
    rnd = random.Random(1)
    docs = {1: None, 2: "", 3: "x", 4: "a <|endoftext|> b"}
    for i in range(5, 300):
        docs[i] = " ".join(rnd.choice(["alpha", "beta", "Gamma,", "δέλτα", "12"]) for _ in range(rnd.choice([3, 40, 200, 900])))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs.items()], "doc_id long, text string, kind int, length int")
    rows = K.pack(df, capacity=256, step=4).collect()
    n = check(rows, docs, 256)
    assert sum(r.length for r in rows) > 0.95 * 256 * n
    again = K.pack(df.repartition(3), capacity=256, step=4).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_equal_lengths_and_repeats(spark):
    docs = [(i % 50, "the same text for all") for i in range(500)]
    rows = K.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64, step=8).collect()
    assert len(rows) == 500 and len({r.sequence_id for r in rows}) == -(-500 // (64 // (-(-rows[0].length // 8) * 8)))


def test_empty(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
