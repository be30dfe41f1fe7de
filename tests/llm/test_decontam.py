import duckdb
import pytest

from newsloom.llm import decontam as D

ITEM = "Yesterday Alice bought 12 apples and Alice gave 5 kg of plums to Bob before the market closed at noon"
FILL = "some other words stand here that no item of any test holds at all and they go on "


def cases():
    swap = ITEM.replace("Alice", "Carol").replace("12", "30").replace("5 kg", "7 km").replace("Bob", "Dave")
    clash = ITEM.replace("Alice gave", "Carol gave")
    docs = [
        (1, FILL + ITEM + ". " + FILL, True),
        (2, FILL + swap + " " + FILL, True),
        (3, FILL + " Yesterday Alice bought 12 apples and Carol gave", False),
        (4, FILL * 3, False),
        (5, None, False),
        (6, "", False),
        (8, "  ".join(ITEM.split()) + "\n" + swap, True),
        (9, "short exact item text", True),
        (10, " ".join(ITEM.split()[:7]), False),
        (11, "Tom 1 km Tom 2 km Tom 3 km Tom 4 km Tom 5", False),
    ]
    items = [(1, ITEM), (2, None), (3, ""), (4, "short exact item text"), (5, "two words"), (6, "Tom 9 km Tom 9 km Tom 9 km Tom 9 km Tom 9"), (1, ITEM)]
    return docs, items, clash


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, hash string, pos int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return D.contaminated(d, b, **options)


def duck(docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    for i, t in docs:
        con.execute("INSERT INTO documents VALUES (?, ?)", [i, t])
    for i, t in items:
        con.execute("INSERT INTO benchmark VALUES (?, ?)", [i, t])
    return sorted(con.execute(D.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_cases_and_sql(spark, limit):
    docs, items, _ = cases()
    rows = sorted(tuple(r) for r in run(spark, [d[:2] for d in docs], items, broadcast_windows=limit).collect())
    assert {r[0] for r in rows} == {d[0] for d in docs if d[2]}
    assert rows == duck([d[:2] for d in docs], items)


def test_contradicting_slots_do_not_count(spark):
    item = "Alan met Beth while Alan saw Beth near the old Alan house and then some"
    wrong = "then Alan met Beth while Carl saw Dora near the old Emil house and then some"
    right = "then Carl met Dora while Carl saw Dora near the old Carl house and then some"
    rows = run(spark, [(1, wrong), (2, right)], [(1, item)]).collect()
    assert rows and {r.doc_id for r in rows} >= {2}
    assert sorted(map(tuple, rows)) == duck([(1, wrong), (2, right)], [(1, item)])
    short = "so Alan met Beth while Alan saw Beth too"
    rows = run(spark, [(1, short.replace("Alan saw", "Carl saw")), (2, short.replace("Alan", "Carl"))], [(1, short)]).collect()
    assert {r.doc_id for r in rows} == {2}


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    docs, items, _ = cases()
    d = spark.createDataFrame([(i, t, i) for i, t, _ in docs] + [(None, ITEM, 0), (4, FILL, 4)], "doc_id long, text string, _ids int")
    out = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == d.columns
    assert sorted(r._ids for r in out.collect()) == sorted([d[0] for d in docs if not d[2]] + [0, 4])


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_verbatim_copies_count_however_few_words_are_plain(spark, limit):
    items = [(1, "Calculate 12 + 7 * 3 - 4 / 2"), (2, "Alice Bob Carol Dave Emil Frank Gina Hans Ida Jan"), (3, "Paris saw Alice and Bob")]
    docs = [
        (1, FILL + "Calculate 12 + 7 * 3 - 4 / 2. " + FILL),
        (2, FILL + "Calculate 13 + 7 * 3 - 4 / 2. " + FILL),
        (3, FILL + "with Alice Bob Carol Dave Emil Frank Gina Hans Ida Jan " + FILL),
        (4, FILL + "with Alice Bob Carol Dave Emil Franz Gina Hans Ida Jan " + FILL),
        (5, FILL + "that Paris saw Alice and Bob " + FILL),
        (6, FILL),
    ]
    got = sorted(map(tuple, run(spark, docs, items, broadcast_windows=limit).collect()))
    assert got == [(1, 1, 1), (3, 2, 3), (5, 3, 1)]
    assert got == duck(docs, items)


def questions():
    """Twelve questions and five re-parameterised forms of each: other names, numbers (digits or words) and units."""
    shapes = [
        "{a} has {n} green apples in hand and gives {m} of them to {b} at school.",
        "Every day {a} runs {n} {u} before lunch. How far does {a} run in {m} days?",
        "{a} sees {n} birds. {b} sees {m} birds. {c} sees none of them at all.",
        "A train leaves with {n} people on board and {m} people get off at {a}.",
        "{a} reads {n} pages of a book on each of {m} evenings, says {b}.",
        "If {a} pays {n} {v} for a hat and {m} {v} for shoes, what is left of the money?",
        "Together {a} and {b} plant {n} trees. {a} waters {m} of the trees twice a week.",
        "{a} cuts a rope of {n} {u} into {m} equal parts and hands one part to {b}.",
        "There were {n} frogs in the pond until {a} carried {m} frogs over to {b}.",
        "{a} bakes {n} loaves and sells all but {m} loaves before the shop of {b} shuts.",
        "What is the sum of the ages if {a} is {n} years old and {b} is {m} years old?",
        "{a} needs {n} litres of paint for the wall, but the shop of {b} has only {m} litres.",
    ]
    sets = [
        {"a": "Ann", "b": "Bea", "c": "Cid", "n": "5", "m": "three", "u": "km", "v": "euros"},
        {"a": "Bob", "b": "Uma", "c": "Vic", "n": "7", "m": "2", "u": "miles", "v": "dollars"},
        {"a": "Eve", "b": "Gus", "c": "Hal", "n": "twelve", "m": "4", "u": "km", "v": "pounds"},
        {"a": "Ivo", "b": "Jon", "c": "Kim", "n": "18.5", "m": "six", "u": "meters", "v": "euros"},
        {"a": "Leo", "b": "Mia", "c": "Ned", "n": "forty", "m": "Nine", "u": "cm", "v": "dollars"},
        {"a": "Oda", "b": "Pam", "c": "Rob", "n": "1,200", "m": "35", "u": "mm", "v": "pounds"},
    ]
    items = [(k, s.format(**sets[0])) for k, s in enumerate(shapes)]
    docs = [(10 * k + v, FILL + s.format(**sets[v]) + " " + FILL, k) for k, s in enumerate(shapes) for v in range(1, len(sets))]
    return items, docs


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_recall_on_reparameterised_questions(spark, limit):
    items, docs = questions()
    clean = [(1000 + k, FILL + f"Today {a} and {b} talked of {n} other things that no question asks about") for k, (a, b, n) in enumerate([("Ann", "Bob", 5), ("Eve", "Mia", "ten")])]
    rows = run(spark, [d[:2] for d in docs] + clean, items, broadcast_windows=limit).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    want = {(i, k) for i, _, k in docs}
    assert len(found & want) >= 0.9 * len(want) and found <= want
    assert sorted(map(tuple, rows)) == duck([d[:2] for d in docs] + clean, items)


def test_long_texts_and_repeated_rows(spark):
    long = FILL * 2000 + ITEM
    docs = [(1, long), (1, long), (2, FILL * 2000), (2, ITEM)]
    got = sorted(map(tuple, run(spark, docs, [(1, ITEM)]).collect()))
    assert [r[0] for r in got] == [1, 2] and got == duck(docs, [(1, ITEM)])


def test_pipeline_stage_drops_verbatim_copies(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "Calculate 12 + 7 * 3 - 4 / 2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, FILL + "Calculate 12 + 7 * 3 - 4 / 2"), (2, FILL)], "doc_id long, text string")
    assert [r.doc_id for r in P.decontaminate(spark, docs, str(tmp_path)).collect()] == [2]


def test_empty(spark):
    none, docs = [], [(1, ITEM)]
    assert run(spark, none, [(1, ITEM)]).collect() == []
    assert run(spark, docs, none).collect() == []


def test_plan_has_no_python(spark):
    docs, items, _ = cases()
    plan = run(spark, [d[:2] for d in docs], items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
