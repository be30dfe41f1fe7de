import numpy as np
import pytest

from newsloom.operators.vector_index import VectorIndex

SCHEMA = "id long, embedding array<float>, block string"


def cloud(n, seed=1, dim=16, blocks=("x", "y", None)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(k, (centres[rng.integers(9)] + rng.normal(size=dim) * 0.5).astype(np.float32).tolist(), blocks[k % len(blocks)]) for k in range(n)]
    return rows + [(n + k, rows[3 * k][1], rows[3 * k][2]) for k in range(10)]  # copies


def brute(rows, threshold, queries=None):
    best = {}
    for i, e, b in sorted(rows, key=lambda r: r[0]):
        best.setdefault((tuple(e), b), i)
    reps = [(i, np.array(e) / np.linalg.norm(e), b) for (e, b), i in best.items()]
    asked = reps if queries is None else [(i, np.array(e) / np.linalg.norm(e), b) for i, e, b in queries]
    return {(i, j): float(x @ y) for i, x, b in asked for j, y, c in reps if b == c and x @ y >= threshold and (queries is not None or i < j)}


def close(got, want):
    assert {(r["a"], r["b"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["sim"] - want[r["a"], r["b"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("lists, threshold", [(1, 0.8), (7, 0.8), (7, 0.97), (25, 0.3)])
def test_pairs_are_exact(spark, tmp_path, lists, threshold):
    rows = cloud(150)
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/i", lists=lists)
    close(index.pairs(threshold).collect(), brute(rows, threshold))
    reps = {r["id"]: r["rep"] for r in index.members.collect()}
    assert len(reps) == len(rows) and all(reps[150 + k] == 3 * k for k in range(10))


def test_insert_within_and_chunks(spark, tmp_path, monkeypatch):
    from newsloom.operators import vector_index

    monkeypatch.setattr(vector_index, "CHUNK", 20)
    rows = cloud(160, seed=4)
    index = VectorIndex.build(spark.createDataFrame(rows[:90], SCHEMA), f"file://{tmp_path}/i", lists=5)
    index.insert(spark.createDataFrame(rows[60:], SCHEMA))  # some are known already
    close(index.pairs(0.85).collect(), brute(rows, 0.85))
    queries = [(1000 + k, e, b) for k, (_, e, b) in enumerate(cloud(40, seed=4))]
    close(index.within(spark.createDataFrame(queries, SCHEMA), 0.9).collect(), brute(rows, 0.9, queries))


def test_probe_recall(spark, tmp_path):
    rows = cloud(300, seed=6, blocks=("x",))
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(df, f"file://{tmp_path}/i", lists=9)
    want = {}
    for (i, j), s in brute(rows, -2, rows).items():
        want.setdefault(i, []).append((-s, j))
    want = {i: {j for _, j in sorted(x)[:5]} for i, x in want.items()}
    for lists, least in ((1, 0.5), (4, 0.9), (9, 1.0)):
        got = {}
        for r in index.probe(df, lists=lists, top=5).collect():
            got.setdefault(r["a"], set()).add(r["b"])
        assert np.mean([len(got[i] & want[i]) / len(want[i]) for i in want]) >= least


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [0.0, 0.0], "x"), (2, None, "x"), (3, [1.0, 0.0], "x"), (4, [2.0, 0.0], "x"), (5, [1.0, 0.1], "x"), (6, [1.0, 0.0], None)]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/i")
    assert [(r["a"], r["b"]) for r in index.pairs(0.9).collect()] == [(3, 5)]  # 4 is a copy of 3
    empty = VectorIndex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert empty.pairs(0.5).collect() == [] and empty.within(spark.createDataFrame(rows, SCHEMA), 0.5).collect() == []


def test_lists_over_several_tiles_lose_no_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("newsloom.operators.vector_index.TILE", 30)
    v = np.random.default_rng(4).normal(size=(200, 5))
    index = VectorIndex.build(spark.createDataFrame([(k, x, "x") for k, x in enumerate(v.tolist())], SCHEMA), f"file://{tmp_path}/i", lists=2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.6)) if a < b}
    assert {(r.a, r.b) for r in index.pairs(0.6).collect()} == want
