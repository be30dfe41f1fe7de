import random

import pytest

from newsloom.llm import near_copies as N


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, percent=80):
    """component_id by exact Jaccard of all pairs."""
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    least = {}
    for (i, _), k in zip(rows, label):
        least[k] = min(i, least.get(k, i))
    return sorted((i, least[k]) for (i, _), k in zip(rows, label))


def corpus():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    footer = [rnd.choice(vocabulary) for _ in range(12)]
    rows = [None, "", "a b", "A b", "a b c d e", "a b c d e f", "a b c d e " * 9]
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([15, 40, 120, 300]))]
        if rnd.random() < 0.5:
            base += footer
        rows.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            copy = [rnd.choice(vocabulary) if rnd.random() < share else w for w in base]
            rows.append(" ".join(copy + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 3))]))
    base = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(120):  # one large group whose members are near copies of some others only
        copy = list(base)
        for k in rnd.sample(range(150), 3):
            copy[k] = rnd.choice(vocabulary)
        rows.append(" ".join(copy))
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(1000 + k, t) for k, t in zip(order, rows)]


@pytest.mark.parametrize("sample, hot", [(16, 20_000), (1, 20)])
def test_groups_equal_brute_force_jaccard(spark, monkeypatch, sample, hot):
    monkeypatch.setattr(N, "HOT", hot)  # the second run deals large groups out
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.component_id) for r in N.near_copies(docs, sample=sample).collect())
    want = brute(rows)
    assert got == want and len({c for _, c in want}) < len(rows) - 100


def test_pipeline_stage_finds_near_copies_of_080(spark):
    import corpus_pipeline as P

    rnd = random.Random(9)
    rows = []
    for i in range(40):
        base = [f"v{rnd.randrange(5000)}" for _ in range(105)]
        copy = list(base)
        for k in (10, 50):  # ten of 101 shingles change: Jaccard 91 / 111 = 0.82
            copy[k] = "other"
        far = list(base)
        for k in (10, 50, 90):  # Jaccard 86 / 116 = 0.74: no near copy of the first
            far[k] = f"far{k}"
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect())
    assert left == sorted(i for i, c in brute(rows) if i == c)
    assert not any(i % 3 == 1 for i in left)


def test_rows_without_id_stay_and_empty(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(None, text), (2, text), (1, text.upper())], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in N.drop_near_copies(docs).collect()) == ["1", "None"]
    assert N.near_copies(docs.limit(0)).collect() == []


def test_leaders_stream_over_batches():
    """However rows are cut into batches, every row of a shared token comes out with its group's first id."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    rows = np.stack([np.sort(rnd.integers(0, 40, 100)), np.full(100, -1), rnd.permutation(100), np.full(100, (50 << 32) + 1)], axis=1)
    rows = np.concatenate([rows, [[99, 0, 1000, (50 << 32) + 1]]])  # a lone row of a hot token's part
    want = []
    for token in np.unique(rows[:, 0]):
        ids = rows[rows[:, 0] == token, 2]
        if len(ids) > 1 or token == 99:
            want += [(token, i, ids[0], i != ids[0]) for i in ids]
    for step in (1, 2, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[k : k + step].T], names=["token", "part", "id", "at"]) for k in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in N._leaders(iter(batches), 80) for r in b.select(["token", "id", "leader", "near"]).to_pylist()]
        assert got == want


def test_parity_bitmaps_bound_the_difference():
    import numpy as np

    rnd = np.random.default_rng(5)
    for n, m in ((3, 4), (60, 900), (2000, 2100), (5000, 0)):
        both = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        more = np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, m, dtype=np.uint64)]))
        both = np.unique(both)
        assert N._differ(N.parities(both), N.parities(more)) <= len(more) - len(both)
        assert N._differ(N.parities(both), N.parities(both)) == 0


def _offers(n, most, told=()):
    """What a group of n classes offers whose sets all may be near copies of each other."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(7)
    both = rnd.integers(0, 1 << 63, 90, dtype=np.uint64)
    maps = [N.parities(np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, 10, dtype=np.uint64)]))) for _ in range(n)]
    at = (100 << 32) + 1
    rows = [(5, -1, a, b, 0, 0, b"") for a, b in told] + [(5, 2, k, k, at, 0, maps[k - 1]) for k in range(1, n + 1)]
    names = ["group", "side", "root", "id", "at", "leader", "parities"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    return [r for b in N._across(iter([batch]), 80, most, chunk=500) for r in b.to_pylist()]


def test_a_group_offers_a_few_pairs_a_class():
    """Not the square of its classes in one go; what is left is told, and later rounds offer every pair once."""
    for n in (40, 80):
        first = _offers(n, N.FEW)
        assert n / 2 <= len(first) <= N.FEW * n and all(r["more"] for r in first)
        assert {k for r in first for k in (r["a"], r["b"])} == set(range(1, n + 1))
    told, more = [], True
    while more:
        made = _offers(40, 8, told)
        more = made[0]["more"]
        told += [(r["a"], r["b"]) for r in made]
    assert sorted(told) == [(a, b) for a in range(1, 41) for b in range(a + 1, 41)]


@pytest.mark.parametrize("hot", [20_000, 20])
def test_rounds_equal_brute_force(spark, monkeypatch, hot):
    """A group whose sets are near copies of some others only, a pair a class and round."""
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "FEW", 1)
    monkeypatch.setattr(N, "MANY", 4)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base, rows = [rnd.choice(vocabulary) for _ in range(150)], []
    for i in range(60):
        copy = list(base)
        for k in rnd.sample(range(20, 150), 4):
            copy[k] = rnd.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in N.near_copies(docs, sample=1).collect())
    assert got == brute(rows)
