import random

import pytest
from test_decontam import duck
from test_packing import check
from test_near_copies import brute as near_copies
from test_quality import verdict

import corpus_pipeline as P
from newsloom.llm import langid

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the people of this town said that they would bring more water to the old houses near the river before the winter comes and that all of the work should be done by the end of the year".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rnd = random.Random(11)
    rows = [(1, None, "en"), (2, "", None), (3, "123 456", "en"), (4, "too short", "en")]
    for i in range(10, 90):
        rows.append((i, " ".join(rnd.sample(GOOD, 30) + rnd.sample(GOOD, 25)), "en" if i % 9 else None))
    item = " ".join(rnd.sample(GOOD, 20))
    rows += [(200, rows[20][1], "en"), (201, rows[20][1] + " more", "en"), (202, " ".join(rnd.sample(GOOD, 20)) + ". " + item + " and then", "en"), (203, "x " * 400, "en"), (10, rows[4][1], "en")]
    full = [(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, item


def test_every_stage_equals_its_brute_force_version(spark, folder):
    d, rows, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    out = P.language_id(spark, docs, d)
    model = langid.fit(docs)
    want = [r for r in rows if langid.Labeller(model).predict([r[1]])[0] != ["und"]]
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in want)
    assert {1, 2, 3} & {r[0] for r in want} == set()

    out = P.quality_rules(spark, out, d)
    want = [r for r in want if verdict(r[1], r[2])[0]]
    assert len(want) > 60
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in want)

    out = P.near_dedup(spark, out, d)
    comp = dict(near_copies([(i, t) for i, t, _ in want]))
    left = {i: t for i, t, _ in want if comp[i] == i}
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(left) and 201 not in left

    out = P.decontaminate(spark, out, d)
    bad = {r[0] for r in duck(list(left.items()), [(0, item)])}
    assert 202 in bad and out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(left) - bad)

    final = P.run(spark, d).collect()
    check(final, {i: t for i, t in left.items() if i not in bad}, 2048)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
