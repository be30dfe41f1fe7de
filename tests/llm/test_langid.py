import itertools
import random

import numpy as np
import pytest

from newsloom.llm import langid as L

WORDS = {
    "aa": ["talo", "katu", "kissa", "koira", "metsa", "jarvi", "saari", "vuori"],
    "bb": ["house", "street", "thing", "bridge", "wright", "thought", "shore", "cheese"],
    "cc": ["czyn", "szkola", "przed", "chrzan", "dworzec", "krzyz", "brzeg", "wieczor"],
}


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        words = ["".join(rnd.sample(WORDS[lang], 1)) + rnd.choice(WORDS[lang])[:3] for _ in range(rnd.randint(5, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def brute(unary, transitions):
    n, m = unary.shape
    out = np.zeros((n, m))
    start = np.log(np.exp(transitions - transitions.max()).sum(axis=0) / m)
    for path in itertools.product(range(m), repeat=n):
        s = start[path[0]] + sum(unary[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
        for i, y in enumerate(path):
            out[i, y] += np.exp(s)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("chunk", [1, 2, 3, 128])
def test_marginals_equal_all_paths(chunk):
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 7, 2, 6])
    unary, tr = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got = L.marginals(unary, lengths, tr, chunk)
    at = 0
    for n in lengths:
        if n:
            assert got[at : at + n] == pytest.approx(brute(unary[at : at + n], tr), abs=1e-9)
        at += n


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    u, tr = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    gamma, pair = L._pair_marginals(np.exp(u), np.exp(tr))
    flat = np.concatenate([brute(x, tr) for x in u])
    assert gamma.reshape(-1, 3) == pytest.approx(flat, abs=1e-9)
    assert pair.sum() == pytest.approx(2 * 3) and pair.sum(axis=1) == pytest.approx(gamma[:, :-1].sum(axis=(0, 1)))


def test_accuracy_switching_and_edge_cases(spark):
    docs = spark.createDataFrame([(*r, 0) for r in corpus(500, 1)], "doc_id long, text string, lang string, score int")
    model = L.fit(docs)
    assert (np.diag(model.transitions) > model.transitions.mean()).all()
    test = [r for r in corpus(300, 2)]
    pred, score = L.Labeller(model).predict([r[1] for r in test])
    assert np.mean([p == r[2] for p, r in zip(pred, test)]) > 0.97 and 0 <= min(score) and max(score) <= 1
    mixed = "talokat metsajar saarivuo jarvikis kissatal thingbri housestr"
    odd = [(1, None, "aa", 1), (2, "", "aa", 1), (3, "12 ## !", None, 1), (4, mixed, None, 1), (5, mixed, "bb", 1), (6, "talokat " * 5000, "aa", 1)]
    out, names = L.identify(spark.createDataFrame(odd, docs.schema), model)
    assert names == {"lang_pred": "lang_pred", "score": "score_"}
    got = {r.doc_id: (r.lang_pred, r.score_) for r in out.collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4] == got[5] and got[4][0] == "aa" and 0.5 < got[4][1] < 0.95 and got[6][0] == "aa"


def test_small_cache_gives_the_same_answers():
    rows = corpus(200, 3)
    model = L.train([r[1] for r in rows], [r[2] for r in rows], epochs=1, sequences=250)
    texts = [r[1] for r in rows] + [None, " ".join(r[1] for r in rows)]
    a, b = L.Labeller(model).predict(texts), L.Labeller(model, limit=50).predict(texts)
    assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "word", None), (None, None, None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    out, _ = L.identify(docs, model)
    assert {r.lang_pred for r in out.collect()} == {"und"}
    assert L.identify(docs.limit(0), model)[0].collect() == []


def test_held_out_rows_are_not_sampled(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "aa") for i in range(400)], "doc_id long, text string, lang string")
    texts, _ = L.training_sample(docs, "doc_id", "text", "lang")
    assert texts and not any(L.held_out(int(t.split()[1])) for t in texts)


def test_document_languages_and_scores_equal_all_paths(spark):
    """Language and score of short code-switched texts by summing over every labelling."""
    train = corpus(300, 5)
    model = L.train([t for _, t, _ in train], [x for _, _, x in train])
    rnd = random.Random(4)
    texts = [None, "", "12 34 !!", "talo", "talo 12 house", "talokat housestr czynprz", "thought, wrightsho 7 jarvisaa"]
    texts += [" ".join(rnd.choice(WORDS[rnd.choice(list(WORDS))]) for _ in range(rnd.randint(1, 7))) for _ in range(40)]
    want = {}
    for k, t in enumerate(texts):
        words = (t or "").split()
        lettered = np.array([any(c.isalpha() for c in w) for w in words], dtype=bool)
        if not lettered.any():
            want[k] = ("und", 0.0)
            continue
        unary = np.zeros((len(words), len(model.labels)))
        unary[lettered] = model.unary([L.core(w) for w, x in zip(words, lettered) if x])
        shares = brute(unary, model.transitions)[lettered].sum(axis=0)
        want[k] = (model.labels[int(shares.argmax())], shares.max() / lettered.sum())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out, names = L.identify(docs, model)
    for r in out.collect():
        assert r[names["lang_pred"]] == want[r.doc_id][0] and r[names["score"]] == pytest.approx(want[r.doc_id][1], abs=1e-5)


def test_many_languages_are_learned_and_too_many_refused(spark, monkeypatch):
    rows = [(i, f"w{i % 300}a w{i % 300}b w{i % 300}c", f"l{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(set(L.training_sample(docs, "doc_id", "text", "lang")[1])) > 250
    monkeypatch.setattr(L, "MAX_LANGUAGES", 10)
    with pytest.raises(ValueError):
        L.training_sample(docs, "doc_id", "text", "lang")


def test_languages_of_long_texts_are_learned_from_a_span(spark):
    """A language whose labelled texts are all longer than the sampled characters is learned, from anywhere in them."""
    words = {"en": "the house stands near the river and water runs", "de": "das haus steht am fluss und wasser fliesst"}
    rows = [(i, (words["de"] + " ") * 2000 if i % 2 else words["en"], "de" if i % 2 else "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = L.training_sample(docs, "doc_id", "text", "lang")
    assert set(langs) == {"en", "de"} and {len(t) for t, x in zip(texts, langs) if x == "de"} == {L.SAMPLE_CHARS}
    assert len({t[:40] for t, x in zip(texts, langs) if x == "de"}) > 5  # spans begin at many places
    out, names = L.identify(docs, L.train(texts, langs))
    assert all(r[names["lang_pred"]] == r.lang for r in out.collect())


def test_the_model_keeps_to_its_weights(monkeypatch):
    texts, langs = [f"w{i}x w{i}x o{i}y o{i}y" for i in range(60)], [f"l{i % 6}" for i in range(60)]
    monkeypatch.setattr(L, "MAX_WEIGHTS", 6 * (L.BUCKETS + 50))
    model = L.train(texts, langs)
    assert model.weights.size <= L.MAX_WEIGHTS and len(model.lexicon) == 50
