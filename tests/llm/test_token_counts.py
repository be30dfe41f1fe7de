import random

from pyspark.sql import functions as F

from newsloom.llm import token_counts as C
from newsloom.llm.common import bpe, default_ranks

ENCODE = bpe(default_ranks()).raw


def count(text):
    return len(ENCODE(text)) // 4


def make(rnd, n):
    return "".join(rnd.choice(["word", " ", " ", "  ", "\n", "x1 ", "é", "!!", " the", "\t", "'s ", "   "]) for _ in range(n))


def test_edits_equal_recount():
    rnd = random.Random(9)
    for case in range(150):
        text = make(rnd, rnd.choice([0, 1, 20, 400, 1500]))
        tree = C.build(text, ENCODE)
        assert tree.total == count(text) and tree.chars[1] == len(text)
        for _ in range(12):
            a = rnd.randint(0, len(text) + 3)
            b = a + rnd.choice([-2, 0, 1, 3, 30, 400, 2000])
            r = make(rnd, rnd.choice([0, 1, 2, 30, 300])) if rnd.random() < 0.8 else rnd.choice([" ", "\n", "  "])
            start, stop = max(0, min(a, len(text))), max(min(a, len(text)), min(b, len(text)), 0)
            want = text[:start] + r + text[stop:]
            text, _ = C.edit(text, tree, a, b, r, ENCODE)
            assert text == want and tree.total == count(text) and tree.chars[1] == len(text), case


def test_batches_equal_recount():
    rnd = random.Random(10)
    for case in range(200):
        text = make(rnd, rnd.choice([0, 1, 20, 400, 2500]))
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(2 * rnd.randint(1, 12)))
        edits = [(a, b, make(rnd, rnd.choice([0, 1, 2, 40]))) for a, b in zip(cuts[::2], cuts[1::2])]
        edits = [e for k, e in enumerate(edits) if not k or edits[k - 1][0] < e[0]][::-1]
        want = text
        for a, b, r in edits:
            want = want[:a] + r + want[b:]
        tree = C.build(text, ENCODE)
        new, _ = C.edit_batch(text, tree, edits[::-1], ENCODE)
        assert new == want and tree.total == count(want) and tree.chars[1] == len(want), case
        other = C.Tree.unpacked(C.build(text, ENCODE).packed())
        assert C.apply(text, other, edits, ENCODE)[0] == want and other.total == count(want)
        for _ in range(3):  # the tree stays good for single edits
            a = rnd.randint(0, len(new))
            new, _ = C.edit(new, tree, a, a + 2, "x y", ENCODE)
            assert tree.total == count(new)


def test_small_edits_touch_little():
    text = "some plain words here " * 5000
    tree = C.build(text, ENCODE)
    _, touched = C.edit(text, tree, 50_000, 50_004, "other", ENCODE)
    assert touched < 4 * C.LEAF_CHARS


def test_edits_encode_only_what_they_touch():
    encoded = []

    def counting(t):
        encoded.append(len(t))
        return ENCODE(t)

    text = "some plain words here " * 5000
    tree = C.Tree.unpacked(C.build(text, ENCODE).packed())  # as a stored tree comes back
    new, again = C.apply(text, tree, [(90_000, 90_004, "x"), (50_000, 50_004, "other"), (10, 14, "")], counting)
    assert sum(encoded) == again < 8 * C.LEAF_CHARS and tree.total == count(new)
    encoded.clear()
    assert C.apply(new, tree, [], counting) == (new, 0) and not encoded


TEXTS = [(1, None), (2, ""), (3, "plain text"), (4, "mail a.b@c.org or 10.1.2.3 ### " + "0123456789abcdef" * 2), (5, "long text here " * 3000 + "!!!! end"), (5, "another text of 5 ##"), (None, "no id ##"), (None, "no id ##")]


def test_trees_are_kept_over_passes(spark):
    from newsloom.llm.common import stored

    df = spark.createDataFrame([(*t, 0, b"x") for t in TEXTS], "doc_id long, text string, n_edits int, tree binary").repartition(3)
    trees = stored(C.plant(df), "trees")
    assert sorted(((r.doc_id, r.tokens, r.chars) for r in trees.collect()), key=str) == sorted(((i, count(t or ""), len(t or "")) for i, t in TEXTS), key=str)
    edited, name = C.with_scrub_edits(df)
    want = {}
    for r in edited.collect():
        new = r.text or ""
        for e in r[name]:
            new = new[: e.start] + e.replacement + new[e.stop :]
        want[r.doc_id, r.text or ""] = (new, len(r[name]))
    updates = stored(C.apply_edits(edited.where(f"size({name}) > 0"), trees, edits=name), "updates")
    assert {(r.doc_id, r.text) for r in updates.collect()} == {(i, new) for (i, _), (new, n) in want.items() if n}
    got = C.counts_after(trees, updates).collect()
    expected = []
    for i, t in TEXTS:
        new, n = want[i, t or ""]
        expected.append((i, count(t or ""), count(new), len(t or ""), len(new), n))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(expected, key=str)
    assert all((r.chars_encoded > 0) == (r.n_edits > 0) and r.chars_encoded < 3000 for r in got)

    # The second pass starts from the stored trees and the new texts; a version that has no tree gives no row.
    trees = stored(C.renewed(trees, updates), "trees")
    texts = updates.select("doc_id", "text").unionByName(spark.createDataFrame([(3, "plain text"), (99, "x")], "doc_id long, text string"))
    kind = "array<struct<start:bigint,stop:bigint,replacement:string>>"
    again = C.apply_edits(texts.selectExpr("*", f"array(named_struct('start', 0L, 'stop', 2L, 'replacement', 'zz yy')) AS edits").withColumn("edits", F.col("edits").cast(kind)), trees)
    rows = again.collect()
    assert len(rows) == len({(i, t) for i, t in TEXTS if want[i, t or ""][1]}) + 1
    for r in rows:
        assert r.tokens_after == count(r.text) and r.text.startswith("zz yy") and r.chars_encoded < 3000
    last = {(r.doc_id, r.version): r.tokens for r in C.renewed(trees, again).collect()}
    assert all(last[r.doc_id, r.new_version] == count(r.text) for r in rows)


def test_query_equals_recount(spark, tmp_path):
    from newsloom.llm.queries import op8_edit_aware_counts

    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.tokens_before, r.chars_before, r.n_edits) for r in op8_edit_aware_counts(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, count(t or ""), len(t or ""), len(C.scrub_edits(t))) for i, t in TEXTS), key=str)


def test_empty_and_null_edits(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, edits array<struct<start:long,stop:long,replacement:string>>")
    trees = C.plant(df)
    assert sorted((r.tokens_before, r.tokens_after, r.n_edits) for r in C.apply_edits(df, trees).collect()) == [(0, 0, 0), (2, 2, 0)]
    assert C.plant(df.limit(0)).collect() == C.apply_edits(df.limit(0), trees).collect() == []
