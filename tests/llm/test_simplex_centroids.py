import hashlib

import duckdb
import numpy as np
import pytest

from newsloom.llm import simplex_centroids as S
from newsloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string, d int"


def brute(rows, k=S.CENTROIDS, rounds=S.ROUNDS):
    """rows: (vec_id, list of floats) -> the result, by comparing with every centroid."""
    kept = [(i, np.floor(np.array(e, dtype=np.float32).astype(float) * 256).astype(np.int64)) for i, e in rows if e is not None and len(e) == 64 and None not in e and np.isfinite(e).all()]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c = np.array([v for _, v in first])
    v = np.array([x for _, x in kept])
    for r in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        of = d.argmin(axis=1)
        if r < rounds:
            for j in set(of.tolist()):
                c[j] = v[of == j].sum(axis=0) // (of == j).sum()
    best = d[np.arange(len(v)), of]
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return [(i, int(o), int(b), int(best[of == o].sum()), int(best.sum()), sha[o]) for (i, _), o, b in zip(kept, of, best)]


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)


def same(spark, rows, **more):
    got = [tuple(r) for r in S.cluster(table(spark, rows), **more).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, **{x: y for x, y in more.items() if x != "pivots"}), key=key)
    return got


def some(n, seed=1, scale=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 64)) * scale
    return [(int(i), (centres[i % 7] + rng.normal(size=64) * 0.1).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    assert len(same(spark, some(300))) == 300


@pytest.mark.parametrize("pivots", [1, 2, 40])
def test_any_number_of_pivots(spark, pivots):
    same(spark, some(90), pivots=pivots, rounds=2)


def test_odd_rows(spark):
    e = some(60)
    odd = [
        (None, e[3][1]), (None, None), (900, []), (901, [0.5] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] * 64), (904, [float("inf")] * 64),
        (905, [0.0] * 64), (905, [0.0] * 64), (906, [-0.001] * 64), (906, [3000.0] + [0.0] * 63), *e[:5],
    ]
    same(spark, e + odd)


def test_few_and_equal_vectors(spark):
    assert S.cluster(table(spark, [])).collect() == []
    assert S.cluster(table(spark, [(1, [1.0])])).collect() == []
    same(spark, some(5))
    assert {r[1] for r in same(spark, [(i, [0.25] * 64) for i in range(50)])} == {0}


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        S.cluster(table(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (500, 64))
    c = v[:40] + rng.integers(-50, 50, (40, 64))
    simplex = S.Simplex.of(c)
    d, dc = S.squared(v, simplex.pivots), S.squared(c, simplex.pivots)
    true = S.squared(v, c).astype(float)
    (f, h), (fc, hc) = simplex.apexes(d), simplex.apexes(dc)
    foot = ((f[:, None] - fc[None]) ** 2).sum(axis=2)
    assert (foot + (h[:, None] - hc[None]) ** 2 <= true * (1 + 1e-9) + 1e-6).all()
    assert (foot + (h[:, None] + hc[None]) ** 2 >= true * (1 - 1e-9) - 1e-6).all()
    # Vectors near a space of fewer dimensions than there are pivots: hardly more than the nearest is left.
    c = rng.integers(-60, 60, (40, 10)) @ rng.integers(-3, 4, (10, 64))
    simplex = S.Simplex.of(c)
    near = c[rng.integers(0, 40, 500)] + rng.integers(-5, 5, (500, 64))
    of, least, compared = S.nearest(near, S.squared(near, simplex.pivots), c, simplex)
    assert (least == S.squared(near, c).min(axis=1)).all() and (of == S.squared(near, c).argmin(axis=1)).all()
    assert 500 <= compared < 0.1 * 500 * 40


def test_query_equals_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in QUERIES["op11_simplex_centroids"](spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.execute(S.oracle_sql()).fetchall()) and got
