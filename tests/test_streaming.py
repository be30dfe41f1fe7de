import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.operators.dedup import merge_upsert
from newsloom.streaming import flows as W

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def feed(spark, tmp_path):
    """feed(schema, batch, batch, ...) -> stream that reads one file a batch."""

    def make(schema, *batches, name="in"):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    return make


def test_dedup_and_history(spark, feed, tmp_path):
    s = feed("url string, ts timestamp", [("a", at(0)), ("a", at(1)), ("b", at(1))], [("b", at(2)), ("c", at(3)), ("old", at(3))])
    history = spark.createDataFrame([("old",)], "url string")
    assert sorted(r.url for r in W.drain(W.dedup_with_history(s, ["url"], history), f"{tmp_path}/o").collect()) == ["a", "b", "c"]


def test_windows_equal_batch(spark, feed, tmp_path):
    rows = [(k % 3, at(k * 0.7)) for k in range(60)]
    s = feed("cluster_id long, ts timestamp", rows, [(9, at(500))])
    got = {(r.start, r.cluster_id): r.n for r in W.drain(W.velocity(s), f"{tmp_path}/o").collect()}
    batch = spark.createDataFrame(rows, "cluster_id long, ts timestamp").groupBy(F.window("ts", "6 hours", "1 hour"), "cluster_id").count()
    assert got == {(r.window.start, r.cluster_id): r["count"] for r in batch.collect()}


def test_sessions_close_after_idle_time(feed, tmp_path):
    s = feed("cluster_id long, ts timestamp", [(1, at(0)), (1, at(20)), (1, at(100)), (2, at(5))], [(3, at(400))])
    got = sorted((r.cluster_id, r.n, r.last_ts) for r in W.drain(W.story_sessions(s), f"{tmp_path}/o").collect())
    assert got == [(1, 1, at(100)), (1, 2, at(20)), (2, 1, at(5))]


def test_growth_brings_new_owners_only_in_the_window(feed, tmp_path):
    p = feed("post_id long, cluster_id long, post_ts timestamp, posted_owners array<string>", [(1, 7, at(0), ["x"])], name="p")
    a = feed("cluster_id long, owner string, ts timestamp", [(7, "x", at(1)), (7, "y", at(2)), (7, "z", at(60)), (8, "y", at(1))], name="a")
    assert [(r.post_id, r.owner) for r in W.drain(W.story_growth(p, a), f"{tmp_path}/o").collect()] == [(1, "y")]


def test_promotion_or_expiry(feed, tmp_path):
    s = feed("cluster_id long, ts timestamp, owner string", [(1, at(0), "a"), (2, at(0), "a")], [(1, at(1), "b"), (1, at(2), "c"), (2, at(9), "b")], [(5, at(50), "a")], [(6, at(99), "a")])
    got = {(r.cluster_id, r.outcome) for r in W.drain(W.promotion(s), f"{tmp_path}/o").collect()}
    assert {(1, "promoted"), (2, "expired")} <= got


def test_clustering_goes_on_from_its_state(feed, tmp_path):
    e = lambda *v: [float(x) for x in v]
    s = feed("block string, id long, ts timestamp, embedding array<float>", [("a", 1, at(0), e(1, 0)), ("a", 2, at(1), e(0, 1))], [("a", 3, at(2), e(1, 0.1)), ("b", 4, at(2), e(1, 0)), ("a", 5, at(90), e(1, 0))])
    assert {r.id: r.story for r in W.drain(W.cluster_stream(s), f"{tmp_path}/o").collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_idle_stories_leave_by_timer(feed, tmp_path, monkeypatch):
    """After the watermark has passed a story's window no state of it is left, though its block got no newer row."""
    e = lambda *v: [float(x) for x in v]
    s = feed("block string, id long, ts timestamp, embedding array<float>", [("a", 1, at(0), e(1, 0)), ("a", 2, at(1), e(0, 1))], [("b", 3, at(200), e(1, 0))], [("b", 4, at(201), e(1, 0)), ("a", 5, at(202), e(1, 0))])
    query = W.cluster_stream(s)
    assert {r.id: r.story for r in W.drain(query, f"{tmp_path}/o").collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    left = query.sparkSession.read.format("statestore").option("path", f"{tmp_path}/o/checkpoint").option("stateVarName", "stories").load()
    leads = {r[0] for r in left.selectExpr("user_map_key.lead" if "user_map_key" in left.columns else "key.lead").collect()}
    assert leads == {3, 5}


def test_stream_of_vectors_equals_the_batch(spark, sf_dir):
    from newsloom.operators import similarity
    from newsloom.plans.streams import QUERIES

    got = {r.id: r.story for r in QUERIES["stream_clusters"](spark, sf_dir).collect()}
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("b"), F.col("vec_id") % 2).alias("block"), (F.col("vec_id") * 7919 % 43200).alias("pub_min"))
    assert got == {r.id: r.story for r in similarity.cluster(v, 0.3, 48, ["block"], bound_first=False).collect()} and len(set(got.values())) < len(got)


def test_upserts_touch_their_buckets_and_happen_once(spark, feed, tmp_path):
    import os

    s = feed("k string, n long", [(f"k{i}", 1) for i in range(40)], [("k1", 2), ("new", 5)], [("k1", 1)])
    merge = lambda old, batch: merge_upsert(old, batch, ["k"], {"n": "add"})
    folder = f"{tmp_path}/t"
    got = {r.k: r.n for r in W.upsert_each_batch(s, folder, ["k"], merge, 16).collect()}
    want = {f"k{i}": 1 for i in range(40)} | {"k1": 4, "new": 5}
    assert got == want
    files = lambda b: [d for d in os.listdir(f"{folder}/data/{b}") if d.startswith("bucket=")]
    assert len(files(1)) <= 2 and len(files(2)) == 1
    # A batch that comes again after its commit changes nothing, and the table can be read later.
    table = W.KeyedTable(spark, folder, ["k"], 16)
    table.upsert(spark.createDataFrame([("k1", 1)], "k string, n long"), 2, merge)
    assert {r.k: r.n for r in table.read(s.schema).collect()} == want
    table.upsert(spark.createDataFrame([("k1", 1)], "k string, n long"), 3, merge)
    assert {r.k: r.n for r in table.read(s.schema).collect()} == want | {"k1": 5}
    assert len(files(1)) < 2 or not any(x in files(2) for x in files(1))  # what nobody names any more is gone
    assert W.KeyedTable(spark, f"{tmp_path}/none", ["k"]).read(s.schema).collect() == []


def test_taps_and_quota(feed, tmp_path):
    s = feed("user_id long, ts timestamp", [(k % 4, at(k)) for k in range(24)], [(1, at(24 * 30))])
    (r,) = [r for r in W.drain(W.weekly_taps(s), f"{tmp_path}/o").collect()]
    assert (r.taps, r.users) == (24, 4)
    rows = [(k, "x" if k % 3 else "y", at(1.5 * k if k % 5 else 1.5 * k + 0.25)) for k in range(80)]
    q = feed("id long, channel string, ts timestamp", rows[40:50] + rows[:20], rows[20:40] + rows[50:], [(-1, "x", at(9999)), (-2, "y", at(9999))], name="q")
    # Rows of the second batch are earlier than some of the first; nothing was passed by the watermark before they came.
    got = {r.id: r.n for r in W.drain(W.rolling_quota(q), f"{tmp_path}/q").collect()}
    assert got == {i: sum(c == d and u <= t and t - u <= dt.timedelta(hours=24) for _, d, u in rows) for i, c, t in rows}


def test_growth_keeps_the_articles_of_a_slot_in_packs(feed, tmp_path):
    rows = [(7, f"o{k % 3}", at(1 + k / 100)) for k in range(300)] + [(None, "o0", at(1))]
    p = feed("post_id long, cluster_id long, post_ts timestamp, posted_owners array<string>", [(1, 7, at(0), ["o1"]), (2, 7, at(2.5), ["o0"]), (3, None, at(0), ["o0"])], name="p")
    a = feed("cluster_id long, owner string, ts timestamp", rows, name="a")
    out = W.drain(W.story_growth(p, a), f"{tmp_path}/o")
    want = [(i, o, x) for i, post, own in ((1, at(0), "o1"), (2, at(2.5), "o0")) for c, o, x in rows if c == 7 and o != own and x > post]
    assert sorted((r.post_id, r.owner, r.ts) for r in out.collect()) == sorted(want)
    assert 0 < out.sparkSession.read.format("statestore").option("joinSide", "right").load(f"{tmp_path}/o/checkpoint").count() < 30


def test_growth_keeps_the_posts_of_a_slot_in_packs(feed, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "PACK", 64)
    posts = [(k, 7 + k % 2, at(k / 100), ["o1"] if k % 3 else []) for k in range(400)]
    late = [(1000 + k, 7, at(30 + k / 10), ["o0", "o2"]) for k in range(50)]
    rows = [(7 + k % 2, f"o{k % 3}", at(k / 8)) for k in range(600)]
    p = feed("post_id long, cluster_id long, post_ts timestamp, posted_owners array<string>", posts, late, name="p")
    a = feed("cluster_id long, owner string, ts timestamp", rows[:300], rows[300:], name="a")
    out = W.drain(W.story_growth(p, a), f"{tmp_path}/o")
    want = [(i, c, o, x) for i, c, post, own in posts + late for d, o, x in rows if c == d and o not in own and post < x <= post + dt.timedelta(hours=48)]
    assert sorted((r.post_id, r.cluster_id, r.owner, r.ts) for r in out.collect()) == sorted(want)
    assert 0 < out.sparkSession.read.format("statestore").option("joinSide", "left").load(f"{tmp_path}/o/checkpoint").count() < 400


def test_promotion_keeps_stories_in_buckets(feed, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BUCKETS", 3)
    first = [(k, at(0), "a") for k in range(40)] + [(None, at(0), "a")]
    then = [(k, at(1 + j), o) for k in range(0, 40, 2) for j, o in enumerate("bc")] + [(1, at(5), "b"), (1, at(5), "c")]
    s = feed("cluster_id long, ts timestamp, owner string", first, then, [(99, at(50), "a")], [(99, at(99), "a")])
    got = sorted(((r.cluster_id, r.outcome) for r in W.drain(W.promotion(s), f"{tmp_path}/o").where("cluster_id IS NULL OR cluster_id < 99").collect()), key=str)
    assert got == sorted([(k, "promoted" if k % 2 == 0 else "expired") for k in range(40)] + [(None, "expired")], key=str)
    assert s.sparkSession.read.format("statestore").option("stateVarName", "stories").load(f"{tmp_path}/o/checkpoint").count() <= 4
