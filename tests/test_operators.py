import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import dedup, entities, gates, issues, reports, similarity
from newsloom.operators import stories as S
from newsloom.plans.views import LEANS, Tables
from newsloom.sources import tables as B

MEMBER = "cluster_id long, id long, source_id string, lean string, lean_value int, type string, owner_group string, weight double, title string, body string, pub_min long, source_name string"


def members(spark, *stories):
    """Each story: [(lean, type, owner)]."""
    rows, i = [], 0
    for c, story in enumerate(stories):
        for lean, kind, own in story:
            i += 1
            rows.append((c, i, f"s{i}", lean, LEANS.index(lean) - 3 if lean in LEANS else None, kind, own, 1.0, f"t{i}", None, 0, f"n{i}"))
    return spark.createDataFrame(rows, MEMBER)


def test_spectrum_cases(spark):
    p = "press"
    cases = [
        ([("left", p, "a"), ("right", p, "b")], True, False, 4),
        ([("left", p, "a"), ("center", p, "b")], True, False, 2),
        ([("left", p, "a"), ("left", p, "b"), ("far-left", p, "c")], True, True, 1),
        ([("left", p, "a"), ("left", p, "b")], False, True, 0),
        ([("left", p, "a"), ("left", p, "a"), ("left", p, "a")], False, True, 0),
        ([("left", p, "a"), ("center", "agency", "b")], False, True, 0),
        ([("far-left", p, "a"), ("far-right", p, "b")], True, False, 6),
        ([("odd", p, "a")], False, False, 0),
        ([("left", p, ""), ("left", p, ""), ("left", p, None)], True, True, 0),
    ]
    got = {r.cluster_id: r for r in S.spectrum(members(spark, *[c[0] for c in cases]), 0).collect()}
    for k, (_, passes, one_sided, span) in enumerate(cases):
        assert (got[k].passes, got[k].one_sided, got[k].span) == (passes, one_sided, span), k
    assert got[6].score == pytest.approx(11)
    assert S.spectrum(members(spark, cases[6][0]), 720).first().score == pytest.approx(5.5)


def test_repeat_rules(spark):
    rows = [(6, 6, None, (True, False), (True, False)), (6, 6, 10.0, (False, True), (False, True)), (9, 6, 10.0, (True, True), (False, True)), (7, 6, 80.0, (True, True), (False, True)), (14, 10, 20.0, (True, True), (True, True)), (20, 10, 2.0, (True, True), (False, True)), (10, 9, 20.0, (False, True), (False, True)), (4, None, 20.0, (True, True), (True, True))]
    df = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "k long, n long, p long, h double")
    args = F.col("n"), F.col("p"), F.col("h")
    got = df.select("k", *S.repeat_issue(*args), *S.repeat_post(*args)).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(*r[3], *r[4]) for r in rows]


def test_junk_titles(spark):
    m = members(spark, [("left", "press", "a")], [("left", "press", "a"), ("right", "press", "b")])
    titles = {1: "Bonoloto: comprobar el resultado del sorteo de hoy", 2: "Horóscopo de hoy, lunes", 3: "El Congreso aprueba la ley"}
    m = m.withColumn("title", F.create_map(*[x for k, v in titles.items() for x in (F.lit(k), F.lit(v))])[F.col("id").cast("int")])
    assert {r.cluster_id: r.junk for r in S.junk_stories(m).collect()} == {0: True, 1: True}
    assert S.junk_stories(m.where("id = 3")).first().junk is False


def picks_brute(pool, key, order, limit):
    groups = {}
    for x in pool:
        groups.setdefault(key(x), []).append(x)
    out = []
    while len(out) < limit and any(groups.values()):
        for g in order(groups):
            if groups.get(g) and len(out) < limit:
                out.append(groups[g].pop(0))
    return out


def test_diverse_picks_equal_the_loop(spark):
    rnd = random.Random(3)
    stories = [[(rnd.choice(LEANS), rnd.choice(["press", "press", "agency", "official"]), f"o{rnd.randrange(9)}") for _ in range(rnd.randint(1, 12))] for _ in range(40)]
    m = members(spark, *stories)
    best = S.best_article_per_source(m)
    got = {}
    for r in S.pick_diverse(best, 4).orderBy("cluster_id", "pick").collect():
        got.setdefault(r.cluster_id, []).append(r.id)
    rows = [r.asDict() for r in m.collect()]
    for c in range(len(stories)):
        pool = sorted((r for r in rows if r["cluster_id"] == c), key=lambda r: r["source_id"])
        assert got[c] == [x["id"] for x in picks_brute(pool, lambda x: x["lean"], lambda g: sorted(g), 4)]
    links = S.pick_post_links(m, 5).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("owner_group").alias("o")).collect()
    assert all(r.n == r.o <= 5 for r in links)
    assert S.pick_post_links(m, 0).count() == S.newest_per_owner(m).count()


def test_topic_spacing_and_packing(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["p", "p", "p", "p", "e"])], "issue long, position long, topic string")
    assert [r.topic for r in issues.space_topics(df).orderBy("new_position").collect()] == ["p", "p", "p", "e", "p"]
    b = spark.createDataFrame([(1, k, 1500) for k in range(5)] + [(2, 0, 9000), (2, 1, 10)], "issue long, position long, length long")
    assert {(r.issue, r.position): r.message for r in issues.pack_messages(b).collect()} == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 3, (2, 0): 1, (2, 1): 2}
    t = spark.createDataFrame([(k * 16, "x" * 32) for k in range(10)], "id long, text string")
    assert [r.batch for r in issues.token_batches(t, most_items=4).orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_quota_cases(spark):
    day = 1440

    def room(used_24h, used_today, hour):
        now = 10 * day + hour * 60
        rows = [(k, "published", now - (hour * 60 + 30 if k < used_24h - used_today else 1), False) for k in range(used_24h)]
        df = spark.createDataFrame(rows, "post_id long, status string, pub_min long, with_sound boolean")
        return reports.quota(df, now).first().room

    assert [room(5, 5, 19), room(25, 25, 19), room(16, 16, 12), room(16, 16, 18)] == [20, 0, 0, 9]


def test_topic_quota_cases(spark):
    def ok(topic, same, total, cap):
        rows = [(k, "published", k, topic if k < same else "other") for k in range(total)]
        posts = spark.createDataFrame(rows, "post_id long, status string, pub_min long, category string")
        return reports.topic_quota(posts, spark.createDataFrame([(topic, cap)], "topic string, cap double")).first().ok

    assert [ok("sport", 4, 50, 0.1), ok("sport", 5, 50, 0.1), ok("incidents", 9, 50, 0.2), ok("incidents", 10, 50, 0.2), ok("sport", 5, 5, 0.1)] == [True, False, True, False, True]


def test_due_slots(spark):
    rows = [(dt.datetime(2026, 8, 11, 19, 30), True), (dt.datetime(2026, 8, 11, 20, 30), False), (dt.datetime(2026, 1, 15, 20, 30), True), (dt.datetime(2026, 1, 15, 19, 30), False), (dt.datetime(2026, 1, 15, 20, 45), True)]
    got = gates.due_slots(spark.createDataFrame(rows, "ts timestamp, want boolean"), 21, 30).collect()
    assert all(r.due == r.want for r in got)
    hours = spark.createDataFrame([(dt.datetime(2026, 1, 15, h - 1, 5),) for h in (3, 8, 9, 20, 21)], "ts timestamp")
    assert [r.open for r in gates.in_publish_window(hours).orderBy("ts").collect()] == [False, False, True, True, False]


def test_field_gates(spark):
    schema = "k long, headline string, summary string, context string, text string, links array<struct<source_id:string>>"
    five = "Una. Dos. Tres. Cuatro. Cinco."
    rows = [(0, "H", "Una. Dos.", "c", "Una. Dos.", [("a",), ("b",)]), (1, "H.", five, "c", five, [("a",)]), (2, "", "sin final", "", "sin final", []), (3, "H", "Una. dos", "c", "Una. dos", [("a",), ("a",)])]
    df = spark.createDataFrame(rows, schema)
    assert [r.failures for r in gates.issue_fields(df).orderBy("k").collect()] == [[], ["sentences"], ["headline", "context", "ending", "links"], ["ending"]]
    assert [r.failures for r in gates.post_fields(df).orderBy("k").collect()] == [[], ["dot", "sentences"], ["headline"], ["ending"]]
    assert [r.passed for r in gates.link_diversity(df).orderBy("k").collect()] == [True, False, False, False]


def test_answers(spark):
    good = '{"headline": "h", "summary": "s", "topic": "Economy", "confidence": "low"}'
    rows = [(0, good), (1, f"```json\n{good}\n```"), (2, "no object"), (3, '{"headline": "h", "summary": "s", "topic": "x", "confidence": "?"}'), (4, '{"headline": "", "summary": "s"}')]
    got = gates.parse_answers(spark.createDataFrame(rows, "k long, answer string")).orderBy("k").collect()
    assert [(r.valid, r.topic, r.confidence) for r in got] == [(True, "economy", "low"), (True, "economy", "low"), (False, "society", "high"), (True, "society", "high"), (False, "society", "high")]


def test_post_rules_and_sync(spark):
    posts = spark.createDataFrame([(1, 1, "world", "madrid", False, None, True), (2, 2, None, "nowhere", True, "", True), (3, 3, "spain", None, True, "note", False)], "post_id long, cluster_id long, scope string, geo_tag string, one_sided boolean, note string, passes boolean")
    last = spark.createDataFrame([(1, 1000), (3, 0)], "cluster_id long, pub_min long")
    tags = spark.createDataFrame([("madrid",)], "tag string")
    got = {r.post_id: r.failures for r in gates.post_rules(posts, last, tags, 1100).collect()}
    assert got == {1: ["scope", "gap"], 2: ["geo_tag", "one_sided"], 3: ["rule"]}
    p = spark.createDataFrame([(1, 1, 5000, ["a"], True), (2, 1, 0, ["a"], True), (3, 2, 5000, ["x"], True)], "post_id long, cluster_id long, pub_min long, posted_owners array<string>, was_one_sided boolean")
    now = spark.createDataFrame([(1, ["a", "b"], False), (2, ["x"], True)], "cluster_id long, owners array<string>, now_one_sided boolean")
    assert {r.post_id: (r.state, r.new_owners, r.one_sided) for r in gates.sync_state(p, now, 5100).collect()} == {1: ("edited", ["b"], False), 2: ("frozen", ["b"], False), 3: ("unchanged", [], True)}
    # A mark that lifts without new owners is an edit; one that was never there is not set.
    p = spark.createDataFrame([(1, 1, 5000, ["a", "b"], True), (2, 1, 5000, ["a", "b"], False), (3, 2, 5000, ["x"], False), (4, 1, 0, ["a", "b"], True)], p.schema)
    assert {r.post_id: (r.state, r.one_sided) for r in gates.sync_state(p, now, 5100).collect()} == {1: ("edited", False), 2: ("unchanged", False), 3: ("unchanged", False), 4: ("frozen", False)}


def test_related_stories_are_among_posted_ones(spark):
    near = [(k, [1.0, 0.01 * k]) for k in range(1, 8)]  # nearer to 0, without posts
    stories = spark.createDataFrame([(0, [1.0, 0.0]), *near, (20, [1.0, 0.5]), (21, [1.0, 0.4]), (22, [1.0, 0.3]), (23, [1.0, 0.3]), (24, [0.0, 1.0])], "cluster_id long, centroid array<double>")
    when = {20: 190_000, 21: 190_000, 22: 1000, 23: 190_000, 24: 190_000}
    posts = spark.createDataFrame([(100 + k, k, "published", m, 5) for k, m in when.items()] + [(150, 3, "draft", 190_000, 5), (151, 4, "published", 190_000, None), (152, 22, "published", 900, 6)], "post_id long, cluster_id long, status string, pub_min long, message_id long")
    blocked = spark.createDataFrame([(23, 0), (0, 21)], "a long, b long").where("b <> 21")
    for lists in (1, 3):
        got = similarity.related_stories(stories, posts, blocked, 190_100, 0.7, lists=lists).where("cluster_id = 0").orderBy("rank").collect()
        assert [r.related_id for r in got] == [21, 20]  # 22 is too old, 23 blocked, 24 too far
        facts = spark.createDataFrame([(0, "war", ["e1"]), (20, "war", ["e9"]), (21, "sport", ["e2"])], "cluster_id long, topic string, entity_ids array<string>")
        r = similarity.pick_related(similarity.related_stories(stories, posts, blocked, 190_100, 0.7, lists=lists), facts).where("cluster_id = 0").first()
        assert (r.related_id, r.why) == (20, "topic")


def test_alias_matching(spark):
    aliases = spark.createDataFrame([("pp", "pp"), ("sanchez", "pedro sanchez"), ("acs", "acs group")], "entity_id string, alias string")
    names = lambda *x: spark.createDataFrame([(s,) for s in x], "surface string")
    assert [tuple(r) for r in entities.match_exact(names("PP", "ACS"), aliases).collect()] == [("PP", "pp")]
    assert [tuple(r) for r in entities.match_surname(names("Sánchez", "ACS"), aliases).collect()] == [("Sánchez", "sanchez")]
    assert [tuple(r) for r in entities.match_fuzzy(names("Pedro Sanches", "Pedro Sanhes", "unknown"), aliases).orderBy("surface").collect()] == [("Pedro Sanches", "sanchez", 1), ("Pedro Sanhes", "sanchez", 2)]


def test_fuzzy_join_loses_no_pair(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(5, 9))) for _ in range(120)})
    aliases = spark.createDataFrame([(f"e{k:03d}", w) for k, w in enumerate(words[::2])], "entity_id string, alias string")
    got = {r.surface: (r.distance, r.entity_id) for r in entities.match_fuzzy(spark.createDataFrame([(w,) for w in words], "surface string"), aliases).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for w in words:
        near = [(distance(w, a), f"e{k:03d}") for k, a in enumerate(words[::2])]
        near = [n for n in near if n[0] <= (1 if len(w) < 8 else 2)]
        assert got.get(w) == (min(near) if near else None)


def test_facts(spark):
    schema = "fact_id long, entity_id string, fact string, kind string, status string, bucket string, attribution string, topics array<string>, expires_min long"
    rows = [
        (1, "e", "presidente grupo constructora espanola", "evaluative", "candidate", "left", "x", ["a"], None),
        (2, "e", "presidente grupo constructora nacional", "evaluative", "candidate", "right", "y", ["a"], None),
        (3, "e", "polemico gestor deportivo", "evaluative", "candidate", "left", "z", ["b"], None),
        (4, "f", "ministro anterior", "evaluative", "candidate", "left", "z", ["b"], None),
        (5, "g", "Alcalde de Madrid", "role", "active", "left", "z", ["t"], None),
        (6, "g", "condenado en firme", "legal", "active", "left", "z", ["t"], 10),
        (7, "g", "grande empresa", "scale", "active", "left", "z", ["t"], None),
        (8, "g", "polémico", "evaluative", "active", "left", "z", ["u"], None),
    ]
    f = spark.createDataFrame(rows, schema)
    assert {r.fact_id: r.outcome for r in entities.reconcile(f).collect()} == {1: "classified", 2: "classified", 3: "activated", 4: "held"}
    topics = spark.createDataFrame([("g", "t"), ("g", "u")], "entity_id string, topic string")
    picked = [(r.topic, r.fact_id) for r in entities.pick_facts(f, topics, 20).orderBy("topic", "pick").collect()]
    assert picked == [("t", 5), ("t", 7), ("u", 8), ("u", 5)]
    assert [r.status for r in entities.expire_legal(f, 20).where("kind = 'legal'").collect()] == ["stale"]
    new = spark.createDataFrame([(9, "g", " ALCALDE de madrid ", "role", None, "", None, [], None), (10, "g", "nuevo", "role", None, "", None, [], None)], schema)
    assert [r.fact_id for r in entities.save_unique(f, new).collect()] == [10]
    assert sorted(r.fact_id for r in entities.drop_similar(f).collect()) == [1, 3, 4, 5, 6, 7, 8]
    c = spark.createDataFrame([(1, "Alcalde de Madrid desde enero", ["alcalde madrid"]), (2, "alcaldes de madrid", ["alcalde madrid"])], "k long, context string, facts array<string>")
    assert [(r.foreign, r.ok) for r in entities.foreign_words(c, ["desde"]).orderBy("k").collect()] == [(["enero"], False), ([], True)]


def test_admission_and_queues(spark):
    f = spark.createDataFrame([(1, "press", "evaluative", "El Mundo", "Pedro Pérez", ["a", "z"]), (2, "press", "evaluative", "Pérez", "Pedro Pérez", ["a"]), (3, "wiki", "legal", None, "x", ["b"])], "fact_id long, tier string, kind string, attribution string, names string, topics array<string>")
    got = {r.fact_id: (r.status, r.expires_min, r.topics) for r in entities.admit(f, ["a", "b"], 100).collect()}
    assert got == {1: ("candidate", None, ["a"]), 2: ("active", None, ["a"]), 3: ("active", 100 + 43200, ["b"])}
    s = spark.createDataFrame([(1, "El Pérez", 5, None), (2, "perez", 3, "e2"), (3, "Otro", 9, None)], "id long, surface string, at_min long, candidate string")
    q = entities.unresolved(s)
    assert {r.key: (r.n, r.first_min, r.spelling, r.candidate) for r in q.collect()} == {"perez": (2, 3, "perez", "e2"), "otro": (1, 9, "Otro", None)}
    assert [r.key for r in entities.notify_queue(q, spark.createDataFrame([("otro",)], "key string")).collect()] == ["perez"]


def test_recommend_threshold(spark):
    def run(same, diff):
        return similarity.recommend_threshold(spark.createDataFrame([(True, s) for s in same] + [(False, d) for d in diff], "same_story boolean, sim double")).first()

    a = run([0.90, 0.88], [0.40, 0.35])
    assert a.accuracy == 1 and not a.overlap and 0.40 < a.threshold <= 0.88
    assert run([0.60, 0.42], [0.47, 0.30]).overlap
    assert run([0.9], []).threshold is None


def test_clustering_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 6000)), [float(x) for x in base[rng.integers(6)] + 0.3 * rng.normal(size=8)], "ab"[i % 2], f"s{i % 5}") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, pub_min long, embedding array<double>, block string, source_id string")
    got = {r.id: r.story for r in similarity.cluster(df, 0.8, 24, ["block"]).collect()}
    for b in "ab":
        groups = []
        for i, t, v, _, _ in sorted((r for r in rows if r[3] == b), key=lambda r: (r[1], r[0])):
            v, best, top = np.array(v), None, -2
            for g in groups:
                if g["last"] >= t - 1440 and g["first"] <= t + 1440:
                    c = np.mean(g["v"], axis=0)
                    sim = c @ v / np.linalg.norm(c) / np.linalg.norm(v)
                    if sim > top:
                        best, top = g, sim
            if best is not None and top >= 0.8:
                best["v"].append(v)
                best["last"] = max(best["last"], t)
            else:
                best = {"v": [v], "first": t, "last": t, "lead": i}
                groups.append(best)
            assert got[i] == best["lead"]
    s = {r.threshold: r for r in similarity.sweep(df, [0.5, 0.99], 24).collect()}
    assert s[0.99].clusters > s[0.5].clusters and s[0.5].top5[0] == s[0.5].top1


def test_embedding_neighbours_and_dimension(spark):
    docs = spark.createDataFrame([(1, "el congreso aprueba la ley de vivienda"), (2, "El Congreso aprueba la ley de vivienda."), (3, "victoria del equipo en la copa"), (4, None)], "id long, text string")
    e = similarity.hash_embedding(docs, dim=64).withColumn("block", F.lit(0)).withColumn("pub_min", F.lit(0))
    assert [(r.a, r.b) for r in similarity.similar_pairs(e, 0.95, hours=48, bands=8, bits=4).collect()] == [(1, 2)]
    c = e.where("id IN (1, 3)").select(F.col("id").alias("cluster_id"), F.col("embedding").alias("centroid"), F.lit(0).alias("first_min"), F.lit(0).alias("last_min"))
    assert {r.id: r.cluster_id for r in similarity.nearest_centroid(e, c, 0.9).collect()} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(Exception, match="dimension"):
        similarity.check_dimension(e, 65).collect()


def test_feeds_and_upserts(spark):
    item = "<item><title> A </title><link>https://www.x.es/a?utm_source=1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate><description>short</description></item>"
    old = item.replace("01 Jan 2024", "01 Jan 2020").replace("/a?", "/b?")
    body = f"<rss><channel>{item}{item}{old}<item><title></title><link>https://x.es/c</link></item><item><title>N</title><link>https://x.es/n</link></item></channel></rss>"
    got = {(r.url, r.title, r.summary, r.pub_min) for r in B.parse_feeds(spark.createDataFrame([("f", body)], "feed string, body string"), 1000).collect()}
    assert got == {("https://x.es/a", "A", "short", 540), ("https://x.es/n", "N", "", 1000)}
    page = '<head><link rel="alternate" type="application/rss+xml" href="/feed"><link rel=stylesheet href="/x"></head>'
    assert [r.href for r in B.discover_feeds(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()] == ["/feed"]
    a = spark.createDataFrame([("e1", "x"), ("e2", "x"), ("e2", "y")], "entity_id string, alias string")
    m = spark.createDataFrame([("e1", 2), ("e2", 3)], "entity_id string, mentions long")
    al, me = dedup.merge_entities(a, m, spark.createDataFrame([("e2", "e1")], "old_id string, new_id string"))
    assert sorted(map(tuple, al.collect())) == [("e1", "x"), ("e1", "y")] and [tuple(r) for r in me.collect()] == [("e1", 5)]


def test_drop_model_and_retention(spark):
    from newsloom.sources import tables as B

    a = spark.createDataFrame([(1, "b", [1.0], "x", 5, 100), (2, "b", [1.0], "y", 5, 90_000), (3, None, None, "y", 6, 90_000), (4, "b", [1.0], None, 7, 70_000)], "id long, body string, embedding array<double>, embed_model string, cluster_id long, pub_min long")
    got = {r.id: (r.embedding is not None, r.embed_model, r.cluster_id) for r in B.drop_model(a, "x").collect()}
    assert got == {1: (True, "x", 5), 2: (False, None, None), 3: (False, "y", 6), 4: (False, None, None)}
    assert not any(r.embedding for r in B.drop_model(a).collect())
    kept = {r.id: (r.body, r.embedding is not None, r.cluster_id) for r in B.retain(a, 90_000).collect()}
    assert kept == {1: (None, False, 5), 2: ("b", True, 5), 3: (None, False, 6), 4: (None, True, 7)}


def test_vectors_of_two_models_are_refused(spark):
    import pytest as p

    from newsloom.operators import gates

    v = spark.createDataFrame([(1, "m"), (2, "m")], "id long, model string")
    assert gates.one_model(v).count() == 2
    with p.raises(Exception, match="several models"):
        gates.one_model(v.unionByName(v.withColumn("model", F.lit("n")))).collect()


def test_issue_is_written_once(spark, tmp_path):
    items = spark.createDataFrame([(5, 7, ["u"]), (2, 8, ["v"])], "position long, cluster_id long, links array<string>")
    for _ in range(2):
        issues.write_issue(items, 3, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/issue_items").orderBy("position").collect()
    assert [(r.issue_id, r.position, r.cluster_id) for r in rows] == [(3, 1, 8), (3, 2, 7)]
    assert [(r.issue_id, r.n_items) for r in spark.read.parquet(f"{tmp_path}/issues").collect()] == [(3, 2)]


def test_messages_at_most(spark):
    b = spark.createDataFrame([(1, k, 3000) for k in range(5)], "issue long, position long, length long")
    assert sorted(r.position for r in issues.pack_messages(b, most=3).collect()) == [0, 1, 2]


def test_facts_that_repeat_known_ones(spark):
    f = spark.createDataFrame([(2, "e", "minister for housing works"), (3, "e", "mayor town hall")], "fact_id long, entity_id string, fact string")
    known = spark.createDataFrame([(9, "e", "the housing minister works")], "fact_id long, entity_id string, fact string")
    assert [r.fact_id for r in entities.drop_similar(f, known=known).collect()] == [3]


def test_pairs_reach_the_promised_recall_and_the_exact_ones_lose_none(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(150, 64))
    for s in (0.70, 0.78):
        near = s * base / np.linalg.norm(base, axis=1, keepdims=True) + np.sqrt(1 - s * s) * rnd.normal(size=(150, 64)) / 8
        rows = [(i, v.astype(float).tolist(), None if i % 2 else "b", int(i) % 7000) for i, v in enumerate(np.concatenate([base, near]))]
        e = spark.createDataFrame(rows, "id long, embedding array<float>, block string, pub_min long")
        x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sim = x @ x.T
        want = {(i, j) for i in range(300) for j in range(i) if rows[i][2] == rows[j][2] and sim[i, j] >= s}
        want = {(min(p), max(p)) for p in want}
        found = {(r.a, r.b) for r in similarity.similar_pairs(e, s).collect()}
        assert found <= want and len(found) >= 0.9 * len(want)
        for chunk in (2000, 40):
            assert {(r.a, r.b) for r in similarity.exact_pairs(e, s, chunk=chunk).collect()} == want
        timed = {p for p in want if abs(rows[p[0]][3] - rows[p[1]][3]) <= 60}
        assert {(r.a, r.b) for r in similarity.exact_pairs(e, s, hours=1, chunk=3).collect()} == timed


def test_a_vector_is_sent_to_few_tiles(spark):
    """At any number of rows in a window a vector is made once and travels three times: to its tile, and past its own and the next slot's."""
    import numpy as np

    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist(), "b" if i % 3 else None, int(i * 7919 % 240)) for i in range(6000)] + [(9001, [0.0] * 8, "b", 1), (9002, [1.0] * 8, "b", 1), (9003, [1.0] * 8, "b", None)]
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def vector(x):
        made.add(len(x))
        return x

    df = spark.createDataFrame(rows, "id long, raw array<float>, block string, pub_min long").withColumn("embedding", F.when(F.col("id") != 9002, vector("raw"))).drop("raw")
    tiles = []
    dealt = similarity._dealt
    similarity._dealt = lambda *a, **k: tiles.append(dealt(*a, **k)) or tiles[-1]
    try:
        got = {(r.a, r.b) for r in similarity.exact_pairs(df, 0.99, hours=1).collect()}
    finally:
        similarity._dealt = dealt
    assert made.value == 6002 and tiles[0].count() == 3 * 6001
    v = np.array([r[1] for r in rows[:6000]], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at, block = np.array([r[3] for r in rows[:6000]]), np.array([r[2] or "" for r in rows[:6000]])
    near = (v @ v.T >= 0.99) & (np.abs(at[:, None] - at) <= 60) & (block[:, None] == block)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}


def test_streams_of_the_fold_lie_in_many_tasks(spark):
    rows = [(i, float(i % 50), b"", [0.5, 0.6, 0.7, 0.8][i % 4], "abcd"[i // 4 % 4], i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, pub_min double, embedding binary, threshold double, block string, uid long")
    at = similarity._sorted(df, ["threshold", "block"], None).select("threshold", "block", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == 16 and len({r.p for r in at}) >= 8


def test_words_are_summed_in_their_order(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(2)
    tokens = ["w" + "x" * int(n) + str(n % 7) for n in rnd.integers(0, 40, 3000)] + ["ab", "ß", "añb"]
    sums = similarity._Places(16).add(np.zeros(16), tokens)
    monkeypatch.setattr(similarity._Places, "MOST", 30)
    monkeypatch.setattr(similarity._Places, "PART", 11)
    assert similarity._Places(16).add(np.zeros(16), tokens).tobytes() == sums.tobytes() and not similarity._Places(16).add(np.zeros(16), ["ab", "c"]).any()


def test_latin_names_are_restored(spark):
    titles = spark.createDataFrame([(1, "El Leire Díez habla de Barcelona"), (1, "Ana de la Torre y Ronald Araujo"), (1, "Denis Shapovalov gana"), (2, "Leire Díez")], "id long, title string")
    names = entities.latin_names(titles, ["barcelona"], ["El", "La"])
    got = {(r.id, r.name) for r in names.collect()}
    assert {(1, "Leire Díez"), (2, "Leire Díez"), (1, "Araujo")} <= got and not any("Shapovalov" in n for _, n in got)
    posts = spark.createDataFrame([(1, "Сегодня Лейре Диез сказала, что Араухо уходит."), (2, "Пишет Leire Díez, не Лейре Диез."), (3, "Лейре Диез")], "id long, text string")
    texts = {r.id: r.text for r in entities.restore_names(posts, names).collect()}
    assert texts == {1: "Сегодня Leire Díez сказала, что Araujo уходит.", 2: posts.where("id = 2").first().text, 3: "Лейре Диез"}
    # A surname is passed over once its full name stands in the text; a title's order counts.
    titles = spark.createDataFrame([(1, 0, "Pedro Sanchez gana"), (2, 1, "gana Pedro Sanchez"), (2, 0, "Ana Arangoz vuelve")], "id long, position long, title string")
    posts = spark.createDataFrame([(1, "Педро Санчес и снова Санчес"), (2, "Арангос и Педро Санчес"), (3, None)], "id long, text string")
    done = {r.id: (r.text, [tuple(x) for x in r.restored]) for r in entities.restore_names(posts, entities.latin_names(titles, [], [])).collect()}
    assert done[1] == ("Pedro Sanchez и снова Санчес", [("Pedro Sanchez", "Педро Санчес")])
    assert done[2] == ("Arangoz и Pedro Sanchez", [("Arangoz", "Арангос"), ("Pedro Sanchez", "Педро Санчес")]) and done[3] == (None, [])


def test_restored_equals_the_plain_loop(monkeypatch):
    """The same texts as comparing every run of words, and few runs are compared letter by letter."""
    calls, near = [], entities._near
    monkeypatch.setattr(entities, "_near", lambda *x: calls.append(x) or near(*x))

    def plain(text, names):
        made = []
        for name, target in names:
            if not target or name.casefold() in text.casefold():
                continue
            words, n = re.findall("[А-ЯЁ][а-яё]+", text), len(name.split())
            for window in (words[i : i + n] for i in range(len(words) - n + 1)):
                if near(" ".join(window).casefold(), target, 2 if len(target) >= 8 else 1):
                    text = re.sub(r"\s+".join(map(re.escape, window)), lambda _: name, text)
                    made.append((name, " ".join(window)))
                    break
        return text, made

    rnd, runs, put = random.Random(5), 0, 0
    for _ in range(200):
        words = ["".join(rnd.choices("абвгде", k=rnd.randint(2, 7))).capitalize() for _ in range(30)]
        words += rnd.choices(words, k=5) + [w + rnd.choice("аб") for w in rnd.choices(words, k=5)]
        text = "".join(w + rnd.choice([" ", "  ", "\n", "-", ", "]) for w in words)
        names = []
        for k in range(8):
            at, n = rnd.randrange(36), rnd.randint(1, 3)
            target = list(" ".join(words[at : at + n]).casefold())
            for _ in range(rnd.randint(0, 3)):
                target[rnd.randrange(len(target))] = rnd.choice(["", "б", "ге"])
            names.append((" ".join(["Xy\\1"] * (n - 1) + [f"N{k}"]), "".join(target)))
        got = entities.restored(text, names)
        assert got == plain(text, names)
        runs, put = runs + 40 * len(names), put + len(got[1])
    assert put > 500 and len(calls) < runs / 4


def random_facts(seed, n=160, buckets=("", "left", "right", "center")):
    rnd = random.Random(seed)
    words = [f"{c}{c}{c}{c}{d}" for c in "abcdefgh" for d in "xyz"]
    facts = [" ".join(rnd.choices(words, weights=range(1, 25), k=rnd.randint(0, 7))) for _ in range(n)]
    return [(k, f"e{k % 3}", facts[k] if k % 9 else facts[k // 2], "evaluative" if k % 2 else "role", "candidate" if k % 5 else "active", rnd.choice(buckets), "x" if k % 4 else None) for k in range(n)]


def stem_set(text):
    return {w[:5] for w in text.split() if len(w) > 3}


@pytest.mark.parametrize("seed, threshold", [(1, 0.5), (2, 0.7), (3, 1.0)])
def test_fact_joins_equal_the_plain_loops(spark, seed, threshold):
    rows = random_facts(seed)
    f = spark.createDataFrame(rows, "fact_id long, entity_id string, fact string, kind string, status string, bucket string, attribution string")
    over = lambda a, b: bool(a and b) and len(a & b) / min(len(a), len(b)) >= threshold
    # Greedy in order of the id, with known facts before all.
    for known in ([], [r for r in rows if r[0] % 7 == 0]):
        new, want = [r for r in rows if r not in known], set()
        for e in ("e0", "e1", "e2"):
            seen = [stem_set(r[2]) for r in known if r[1] == e]
            for r in sorted(new):
                if r[1] == e and not any(over(stem_set(r[2]), s) for s in seen):
                    seen.append(stem_set(r[2]))
                    want.add(r[0])
        ids = [r[0] for r in known]
        got = entities.drop_similar(f.where(~F.col("fact_id").isin(ids)) if ids else f, threshold, f.where(F.col("fact_id").isin(ids)) if ids else None)
        assert {r.fact_id for r in got.collect()} == want and got.count() == len(want)
    hit = set()
    c = [r for r in rows if r[4] == "candidate"]
    for i, a in enumerate(c):
        for b in c[i + 1 :]:
            if a[1] == b[1] and a[5] and a[5] != b[5] and over(stem_set(a[2]), stem_set(b[2])):
                hit |= {a[0], b[0]}
    got = {r.fact_id: r.outcome for r in entities.reconcile(f, threshold).collect()}
    assert {i for i, o in got.items() if o == "classified"} == hit and len(got) == len(c) and hit


def test_feeds_of_all_kinds(spark):
    rss = '<rss><channel><item><title><![CDATA[A & B]]></title><link>https://x.example/a</link><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate><content:encoded><![CDATA[long text]]></content:encoded><description>d</description><media:thumbnail url="u"/></item></channel></rss>'
    rdf = '<rdf:RDF><item rdf:about="x"><title>R</title><link>https://x.example/r</link><dc:date>2024-01-31T10:00:00Z</dc:date></item></rdf:RDF>'
    atom = """<feed><entry xml:lang="en"><title type="html">T &amp;amp; U</title><link rel='self' href='https://x.example/self'/><link rel="alternate" href="https://x.example/t"/><published>2024-01-31T09:00:00+01:00</published><updated>2024-01-31T20:00:00Z</updated><summary>s</summary></entry>
      <entry><title>V</title><id>https://x.example/v</id></entry><entry><title></title><link href="https://x.example/w"/></entry><entry><title>Old</title><link href="https://x.example/o"/><updated>2023-01-31T20:00:00Z</updated></entry></feed>"""
    feeds = spark.createDataFrame([("rss", rss), ("rdf", rdf), ("atom", atom), ("none", None), ("bad", "<html>")], "feed string, body string")
    got = {(r.feed, r.url): (r.title, r.summary, r.pub_min) for r in B.parse_feeds(feeds, 43200 + 1440).collect()}
    assert got == {
        ("rss", "https://x.example/a"): ("A & B", "long text", 43800), ("rdf", "https://x.example/r"): ("R", "", 43800),
        ("atom", "https://x.example/t"): ("T &amp; U", "s", 43200 + 480), ("atom", "https://x.example/v"): ("V", "", 44640),
    }


def test_middle_outlets_join_the_edges(spark):
    rows = [(1, f"s{k}", k - 3, "press", f"a{k}", 10) for k in range(7)]
    m = spark.createDataFrame([(c, s, v, t, 100 + k, b, 1) for k, (c, s, v, t, b, _) in enumerate(rows)], "cluster_id long, source_id string, lean_value int, type string, id long, body string, pub_min long")
    pick = lambda n: [r.source_id for r in S.spectrum_picks(m, n).orderBy("pick").collect()]
    assert pick(2) == ["s0", "s6"] and pick(3) == ["s0", "s3", "s6"] and pick(5) == ["s0", "s3", "s4", "s2", "s6"] and pick(9) == [f"s{k}" for k in range(7)]


def leader_brute(rows, threshold, window, bound_first, stories=()):
    """rows: (id, minute, vector) of one block; stories: (lead, sum, first, last), open ones."""
    live, out = [[x, np.array(s, dtype=float), a, b] for x, s, a, b in stories], {}
    for i, at, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        at, v, best = float("inf") if at is None else at, np.array(v, dtype=float), None
        for s in live:
            if s[3] >= at - window and (not bound_first or s[2] <= at + window):
                sim = float(s[1] @ v) / ((np.linalg.norm(s[1]) or 1) * (np.linalg.norm(v) or 1))
                if sim >= threshold and (best is None or sim > best[0]):
                    best = sim, s
        if best is None:
            live.append([i, v, at, at])
            out[i] = i
        else:
            s = best[1]
            s[1], s[2], s[3] = s[1] + v, min(s[2], at), max(s[3], at)
            out[i] = s[0]
    return out


@pytest.mark.parametrize("run", [1, 7, 256])
def test_leader_clustering_equals_the_plain_fold(spark, monkeypatch, run):
    monkeypatch.setattr(similarity, "RUN", run)
    rng = np.random.default_rng(run)
    centres = rng.normal(size=(6, 8))
    rows = [(k, None if k % 97 == 5 else int(rng.integers(0, 9000)), (centres[rng.integers(6)] + rng.normal(size=8) * 0.5).tolist() if k % 31 else [0.0] * 8, ["a", "b", None][k % 3]) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, pub_min long, embedding array<double>, block string").repartition(5)
    got = {r.id: r.story for r in similarity.cluster(df, 0.8, 24, ["block"]).collect()}
    for b in ("a", "b", None):
        want = leader_brute([r[:3] for r in rows if r[3] == b], 0.8, 1440, True)
        assert {i: s for i, s in got.items() if i in want} == want


@pytest.mark.parametrize("near, tile", [(2, 7), (64, 50)])
def test_articles_are_compared_in_tiles_and_lone_stories_cost_no_product(spark, monkeypatch, near, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(near)
    centres = rng.normal(size=(4, 8))
    rows = [(k, int(rng.integers(0, 4000)), (centres[rng.integers(4)] + rng.normal(size=8) * 0.6).tolist()) for k in range(200)]
    rows += [(200 + k, rows[k % 9][1] + 40 * k, rows[k % 9][2]) for k in range(40)]  # more copies than a list holds
    df = spark.createDataFrame(rows, "id long, pub_min long, embedding array<double>").withColumn("block", F.lit("a"))
    got = {r.id: r.story for r in similarity.cluster(df, 0.8, 24, ["block"], near=near).collect()}
    assert got == leader_brute(rows, 0.8, 1440, True)
    # Only stories of two or more articles are held as sums.
    fold = similarity.NearFold(0.8, 1440, True)
    fold.add([0, 1], np.array([0, 1]), np.zeros(2), np.eye(2), [[], []], [[], []])
    assert len(fold.sums) == 0 and len(fold.lone) == 2


def test_clustering_goes_on_from_earlier_stories(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 8))
    rows = [(k, 30 * k, (centres[rng.integers(5)] + rng.normal(size=8) * 0.3).tolist(), "a") for k in range(200)]
    schema = "id long, pub_min long, embedding array<double>, block string"
    df = spark.createDataFrame(rows, schema)
    whole = {r.id: r.story for r in similarity.cluster(df, 0.8, 36, ["block"]).collect()}
    early, late = df.where("id < 120"), df.where("id >= 120")
    one = similarity.cluster(early, 0.8, 36, ["block"])
    stories = similarity.story_table(early, one, 3600, ["block"])
    two = similarity.cluster(late, 0.8, 36, ["block"], stories=stories)
    assert {r.id: r.story for r in one.unionByName(two).collect()} == whole
    after = similarity.story_table(late, two, 6000, ["block"], before=stories)
    assert {r.story: r.n for r in after.collect()} == {s: list(whole.values()).count(s) for s in set(whole.values())}
    # A closed story takes nothing, however near it is.
    shut = stories.withColumn("status", F.lit("closed"))
    assert min(r.story for r in similarity.cluster(late, 0.8, 36, ["block"], stories=shut).collect()) >= 120


def test_recorded_sources_are_told_before_the_rows_are_made(spark):
    posts = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, None), (4, None, True)], "post_id long, cluster_id long, recorded boolean")
    rows = [(10, 7, True), (11, 7, False), (12, 8, True), (13, None, True)]
    members = spark.createDataFrame([(i, c, r, "press", -1, "", "s") for i, c, r in rows], "id long, cluster_id long, recorded boolean, type string, lean_value int, owner_group string, source_id string")
    known = spark.createDataFrame([(2, 11), (2, 99)], "post_id long, article_id long")
    new = B.record_sources(posts, members, known)
    assert sorted((r.post_id, r.article_id, r.owner, r.bucket) for r in new.collect()) == [(1, 11, "s", "left"), (2, 10, "s", "left"), (3, 12, "s", "left")]
    assert sorted((r.post_id, r.article_id) for r in B.record_sources(posts.drop("recorded"), members, known).collect()) == [(1, 10), (1, 11), (2, 10), (3, 12)]
    # No shuffle above the join, where the rows are made.
    plan = B.record_sources(posts, members)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("SortMergeJoin") < plan.index("Exchange")


def test_bridge_rows_repeat_at_a_short_distance(spark, tmp_path):
    posts = spark.range(600).select(F.when(F.col("id") > 0, F.col("id")).alias("post_id"), F.lit(7).cast("long").alias("cluster_id"))
    members = spark.range(6000).select("id", F.lit(7).cast("long").alias("cluster_id"), F.lit("press").alias("type"), F.lit(-1).alias("lean_value"), F.lit("").alias("owner_group"), F.concat(F.lit("s"), F.col("id") % 7).alias("source_id"))
    B.record_sources(posts, members).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.count() == rows.distinct().count() == 600 * 6000 and rows.where("post_id IS NULL").count() == 6000
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 600 * 6000


def test_mentions_normalise_a_text_once(spark, monkeypatch):
    made, stored = [], entities.shared.stored
    monkeypatch.setattr(entities.shared, "stored", lambda df, tag: made.append(tag) or stored(df, tag))
    texts = spark.createDataFrame([(1, 5, "Ana  López, y\tmás"), (2, 9, "ana lópez"), (3, 9, "Anana Lopez"), (4, 1, None), (5, 7, "Lopez Ana")], "id long, pub_min long, text string")
    names = spark.createDataFrame([("a", "Ana López"), ("b", "Nobody"), ("c", "")], "entity_id string, name string")
    found = entities.mentions(names, texts)
    assert sorted((r.entity_id, r.id, r.rn) for r in found.collect()) == [("a", 1, 2), ("a", 2, 1)]
    assert len(made) == 1


def test_signed_rounding_keeps_negative_zeros(spark):
    xs = [-1e-6, 1e-6, -0.0, 0.0, 0.123455, -0.123455, -2.5e-6, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(X.round_signed(F.col("x"), 5)).collect()]
    assert [repr(x) for x in got] == ["-0.0", "0.0", "-0.0", "0.0", "0.12346", "-0.12346", "-0.0", "None"]


def test_a_filter_on_a_fact_splits_no_text_again(spark, sf_dir):
    facts = Tables(spark, sf_dir).facts.where("fact LIKE 'a%' AND length(fact) < 50").select("fact", F.upper("fact").alias("u"))
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
