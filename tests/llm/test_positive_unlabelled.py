import zlib

import numpy as np
import pytest

from newsloom.llm import positive_unlabelled as P
from newsloom.llm.queries import QUERIES


def plain(seed, n=1):
    rng = np.random.default_rng(seed)
    words = ["the", "river", "house", "of", "a", "green", "runs", "slowly", "Peter", "evening", "and", "window", "below", "market"]
    return [" ".join(rng.choice(words, rng.integers(20, 60))).capitalize() + "." for _ in range(n)]


def junk(seed, n=1):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list("ABCDX"), 5)) + "$$$!!" for _ in range(rng.integers(20, 60))) for _ in range(n)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    texts = plain(1, 450) + junk(2, 150)
    order = np.random.default_rng(3).permutation(600)
    rows = [(int(k), texts[j], "s", 0.5) for k, j in enumerate(order)]
    good = {int(k): j < 450 for k, j in enumerate(order)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in good.items() if k % 2], "doc_id long, quality long, toxic long")
    return docs, labels, good


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(1, 1, (40, 6)), rng.normal(0, 1, (60, 6)), rng.normal(size=6) * 0.1
    value, g, negative = P.risk(w, p, u, 0.3, 0.01)
    assert negative > 0
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert abs((P.risk(w + step, p, u, 0.3, 0.01)[0] - P.risk(w - step, p, u, 0.3, 0.01)[0]) / 2e-6 - g[k]) < 1e-5
    # By hand, row by row.
    soft = lambda z: np.log(1 + np.exp(z))
    hand = 0.3 * np.mean([soft(-x @ w) for x in p]) + np.mean([soft(x @ w) for x in u]) - 0.3 * np.mean([soft(x @ w) for x in p]) + 0.005 * (w[1:] ** 2).sum()
    assert abs(hand - value) < 1e-12


def test_risk_is_not_negative():
    p, u = np.ones((5, 2)), np.ones((5, 2))
    value, g, negative = P.risk(np.array([3.0, 3.0]), p, u, 1.2)
    assert negative < 0 and value > 0
    assert P.risk(np.array([3.0, 3.0]) - 0.1 * g, p, u, 1.2)[2] > negative  # the step makes up for it


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior(share):
    rng = np.random.default_rng(4)
    p = rng.normal(2, 1, (2000, 5))
    u = np.where(rng.random((4000, 1)) < share, rng.normal(2, 1, (4000, 5)), rng.normal(-1, 1, (4000, 5)))
    one = lambda x: np.concatenate([np.ones((len(x), 1)), x], axis=1)
    assert abs(P.class_prior(one(p), one(u)) - share) < 0.08


def test_held_out_accuracy(spark, corpus):
    docs, labels, good = corpus
    out, names = P.scored(docs, P.fit(docs, labels))
    assert names == {"score": "score_", "predicted": "predicted_"}
    rows = [(r["doc_id"], r["score_"], r["predicted_"]) for r in out.collect()]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in rows)
    hits = [p == good[i] for i, _, p in rows if held(i)]
    assert len(hits) > 80 and np.mean(hits) > 0.95


def test_only_training_labels_of_one_count(spark, corpus):
    docs, labels, _ = corpus
    want = P.fit(docs, labels)
    F = P.F
    changed = labels.withColumn("quality", F.when(P.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).where("quality = 1 OR doc_id % 3 = 0")
    more = changed.unionByName(labels.where("quality = 1"))
    odd = spark.createDataFrame([(None, 1, 0), (99_999, 1, 0), (1, None, 0)], "doc_id long, quality long, toxic long")
    got = P.fit(docs, more.unionByName(odd))
    assert np.array_equal(got.weights, want.weights) and got.prior == want.prior


def test_odd_rows(spark, corpus):
    docs, labels, _ = corpus
    model = P.fit(docs, labels)
    t = plain(9)[0]
    rows = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None), (3, ""), (4, " \n "), (5, "long word " * 40_000), (6, "x" * 300_000)], "doc_id long, text string")
    out = {(r[0], r[1]): r[2] for r in P.scored(rows, model)[0].select("doc_id", "text", "score").collect()}
    assert out[1, t] == out[None, t] and out[2, None] == out[3, ""] == out[4, " \n "]
    assert all(0 <= s <= 1 for s in out.values())
    assert P.scored(rows.limit(0), model)[0].collect() == []
    nothing = P.fit(docs, labels.limit(0))
    assert {r[0] for r in P.scored(rows, nothing)[0].select("score").collect()} == {0.5}
    assert P.fit(docs.limit(0), labels).prior == 0.5


def test_figures_do_not_depend_on_the_batch():
    texts = [*plain(5, 3), *junk(6, 3), "Ünï çode 12 12 12\nline\nline\n", None]
    together, lexicon = P.figures(texts, P.Lexicon()), P.Lexicon()
    alone = np.concatenate([P.figures([t], lexicon) for t in reversed(texts)])[::-1]
    assert np.allclose(together, alone, atol=1e-6)
    at = {n: k for k, n in enumerate(P.FORM)}
    x = together[6]
    assert abs(x[at["digits"]] - 6 / 7) < 1e-6 and abs(x[at["again"]] - 3 / 7) < 1e-6 and abs(x[at["same_lines"]] - 1 / 3) < 1e-6


def test_query(spark, sf_dir):
    rows = QUERIES["op12_positive_unlabelled"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    quality = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()}
    assert len(rows) == docs and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    known = [(r["score"], quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality and r["held_out"]]
    assert np.mean([(s >= 0.3) == q for s, q in known]) > 0.8
