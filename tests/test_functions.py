import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X


def one(spark, rows, schema, column):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], "k long, " + schema)
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def test_canonical_url(spark):
    cases = {
        "https://elpais.com/a.html?utm_source=x&utm_medium=y": "https://elpais.com/a.html",
        "https://elpais.com/a.html?gclid=1&id=7": "https://elpais.com/a.html?id=7",
        "https://www.abc.es/x": "https://abc.es/x",
        "https://amp.abc.es/x": "https://abc.es/x",
        "https://abc.es/x/amp": "https://abc.es/x",
        "https://abc.es/x#comentarios": "https://abc.es/x",
        "https://abc.es/x/": "https://abc.es/x",
        "HTTPS://ABC.ES/Ruta": "https://abc.es/Ruta",
        "https://abc.es/?b=2&a=1": "https://abc.es/?a=1&b=2",
        "https://abc.es//dobles//slashes": "https://abc.es/dobles/slashes",
        "https://abc.es:443/x?blank=&n=1": "https://abc.es/x?n=1",
        "http://abc.es": "http://abc.es/",
        "": "",
        "mailto:a@b.c": "mailto:a@b.c",
    }
    got = one(spark, list(cases), "u string", X.canonical_url(F.col("u")))
    assert got == list(cases.values())
    assert one(spark, got, "u string", X.canonical_url(F.col("u"))) == got
    assert one(spark, [(None,)], "u string", X.canonical_url(F.col("u"))) == [""]


def test_titles(spark):
    same = ["Sánchez anuncia elecciones", "SANCHEZ ANUNCIA ELECCIONES", "Sánchez anuncia elecciones | El País", "¡Sánchez, anuncia: elecciones!"]
    hashes = one(spark, same, "t string", X.title_hash(F.col("t")))
    assert len(set(hashes)) == 1 and len(hashes[0]) == 32
    assert one(spark, [(None,)], "t string", X.normalize_title(F.col("t"))) == [""]


@pytest.mark.parametrize("text,n", [("", 0), ("Una. Dos. Tres.", 3), ("¿Qué? ¡Vaya! Sí.", 3), ("sin punto", 1), (None, 0)])
def test_count_sentences(spark, text, n):
    assert one(spark, [(text,)], "t string", X.count_sentences(F.col("t"))) == [n]


def test_strip_html(spark):
    cases = {"<p>Hola <b>mundo</b></p>": "Hola mundo", "<script>x<1</script>ya": "ya", "a &amp; b": "a & b"}
    assert one(spark, list(cases), "t string", X.strip_html(F.col("t"))) == list(cases.values())


def test_shingles(spark):
    words = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([(words,)], "t string").select(X.words(F.col("t")).alias("w"))
    assert len(df.select(X.shingles(F.col("w"), 10)).first()[0]) == 1
    assert df.select(X.shingles(F.col("w"), 11)).first()[0] == []


def test_entity_key(spark):
    cases = {"Pedro Sánchez": "pedro sanchez", "el PP": "pp", "La Moncloa": "moncloa", "¿Vox?": "vox", "el presidente": "", "Jean-Luc": "jean-luc"}
    assert one(spark, list(cases), "t string", X.entity_key(F.col("t"))) == list(cases.values())


def test_quotes(spark):
    rows = [("«el gobierno no va a ceder»", 'Dijo: "El Gobierno NO va a ceder", y se fue', True), ("esto nunca se dijo así", "otra cosa", False), ("ceder", "no va a ceder", False)]
    got = one(spark, [r[:2] for r in rows], "q string, t string", X.quote_found(F.col("q"), F.col("t")))
    assert got == [r[2] for r in rows]


def test_small_ones(spark):
    assert one(spark, ["Sport ", "a b/c", "!!"], "t string", X.hashtag(F.col("t"))) == ["#sport", "#a_b_c", ""]
    assert one(spark, ["uno dos tres", "corto"], "t string", X.clip(F.col("t"), 9)) == ["uno dos…", "corto"]
    assert one(spark, ["Ángel  Núñez!"], "t string", X.slug(F.col("t"))) == ["angel-nunez"]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(X.cosine(F.col("a"), F.col("b")), X.cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(0.5**0.5) and r[1] == 0


def test_exact_titles_know_compatibility_forms(spark):
    rows = [("ﬁn de la Ｇuerra | El País", "fin de la guerra"), ("STRASSE straße", "strasse strasse"), ("İstanbul  Ǆ", "istanbul dz"), ("Ελλάδα ½", "ελλαδα 1 2"), ("हिन्दी", None), (None, ""), ("а́б — Коммерсантъ", "аб")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    got = [r.n for r in df.select("k", X.exact_title(F.col("t")).alias("n")).orderBy("k").collect()]
    assert all(g == w for g, (_, w) in zip(got, rows) if w is not None)
    assert df.select(X.title_hash(F.col("t"), exact=True)).where("k = 1").first()[0] == df.select(X.title_hash(F.lit("Straße STRASSE"), exact=True)).first()[0]
