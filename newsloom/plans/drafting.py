"""Registered queries of gates, drafts, facts, names and similarity, each over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import dedup, drafts, entities, gates, issues, reports, similarity
from newsloom.operators import stories as S
from newsloom.operators.vector_index import VectorIndex
from newsloom.plans.queries import LAST, SPECTRUM, query, r6
from newsloom.plans.views import AS_OF
from newsloom.sources import shared
from newsloom.sources import tables as B


def words_sql(c: str) -> str:
    """The normalised words of a column, as X.words gives them."""
    fold = rf"""replace(translate(lower(regexp_replace(trim(coalesce({c}, ''), ' '), '\s*[|–—-]\s*[^|–—-]{{2,30}}$', '')), '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss')"""
    return rf"""[x FOR x IN string_split(trim(regexp_replace(regexp_replace({fold}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[ \t\n\r\x0B\f]+', ' ', 'g'), ' '), ' ') IF x <> '']"""


def key_sql(c: str) -> str:
    """The key of a name, as X.entity_key gives it."""
    heads = "|".join(sorted({*X.NAME_PREFIXES, "dona"}))
    fold = f"replace(translate(lower(coalesce({c}, '')), '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss')"
    return rf"""trim(regexp_replace(trim(regexp_replace(regexp_replace({fold}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '[ \t\n\r\x0B\f]+', ' ', 'g'), ' ') || ' ', '^(({heads}) +)+', ''), ' ')"""


def hit_sql(c: str, stems: list[str]) -> str:
    return rf"regexp_matches(coalesce({c}, ''), '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])({'|'.join(sorted(stems))})')"


def sentences_sql(c: str) -> str:
    return rf"len([x FOR x IN regexp_split_to_array(trim(coalesce({c}, ''), ' '), '[.!?…]+(?:\s|$)') IF trim(x, ' ') <> ''])"


# ------------------------------------------------------------------ gates


@query(rf""" SELECT id, [x FOR x IN [CASE WHEN trim(coalesce(title, ''), ' ') = '' THEN 'headline' END, CASE WHEN trim(coalesce(summary, ''), ' ') = '' THEN 'summary' END, CASE WHEN trim(coalesce(body, ''), ' ') = '' THEN 'context' END,
  CASE WHEN {sentences_sql('summary')} > 4 THEN 'sentences' END, CASE WHEN NOT regexp_matches(rtrim(coalesce(summary, ''), ' '), '[.!?…»")]\n?$') THEN 'ending' END, CASE WHEN id % 13 = 0 THEN 'links' END] IF x IS NOT NULL] AS failures FROM articles""")
def issue_field_gate(t):
    links = F.when(F.col("id") % 13 != 0, F.array("url_canonical")).otherwise(F.array().cast("array<string>"))
    items = t.articles.select("id", F.col("title").alias("headline"), "summary", F.col("body").alias("context"), links.alias("links"))
    return gates.issue_fields(items).select("id", "failures")


@query(f""", live AS (SELECT cluster_id, pub_min AS last_min FROM posts WHERE status = 'published' AND message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY pub_min DESC, post_id DESC) = 1),
d AS (SELECT post_id, cluster_id, CASE post_id % 3 WHEN 0 THEN 'world' WHEN 1 THEN 'home' END AS scope, CASE WHEN post_id % 4 > 0 THEN 't' || (post_id % 4) END AS geo, post_id % 5 = 0 AS one_sided, CASE WHEN post_id % 2 = 0 THEN ' ' ELSE 'n' END AS note, post_id % 7 <> 0 AS passes FROM posts)
SELECT post_id, [x FOR x IN [CASE WHEN coalesce(scope = 'world', false) THEN 'scope' END, CASE WHEN geo IS NOT NULL AND geo NOT IN ('t1', 't2') THEN 'geo_tag' END, CASE WHEN one_sided AND trim(note, ' ') = '' THEN 'one_sided' END,
  CASE WHEN last_min IS NOT NULL AND {AS_OF} - last_min < 720 THEN 'gap' END, CASE WHEN NOT passes THEN 'rule' END] IF x IS NOT NULL] AS failures FROM d LEFT JOIN live USING (cluster_id)""")
def post_rule_gate(t):
    k = F.col("post_id")
    d = t.posts.select(
        "post_id", "cluster_id", F.when(k % 3 == 0, "world").when(k % 3 == 1, "home").alias("scope"), F.when(k % 4 > 0, F.concat(F.lit("t"), k % 4)).alias("geo_tag"),
        (k % 5 == 0).alias("one_sided"), F.when(k % 2 == 0, " ").otherwise("n").alias("note"), (k % 7 != 0).alias("passes"),
    )
    tags = t.spark.createDataFrame([("t1",), ("t2",)], "tag string")
    return gates.post_rules(d, S.latest_published(t.posts), tags, AS_OF).select("post_id", "failures")


@query(r"""WITH c AS (SELECT conv_id, turn, length(text) AS n, (turn + length(text)) % 4 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 1 THEN 'H' || n WHEN 2 THEN '' WHEN 3 THEN 'H' END AS headline, CASE k WHEN 1 THEN 'politics' ELSE 'society' END AS topic, CASE k WHEN 1 THEN 'low' ELSE 'high' END AS confidence, k IN (1, 3) AS valid FROM c""", plain=True)
def parsed_answers(t):
    n = F.length("text")
    shapes = {
        1: F.concat(F.lit('Here it is: ```json\n{"headline": "H'), n, F.lit('", "summary": "s", "topic": "Politics", "confidence": "low"}\n``` done')),
        2: F.lit('{"headline": "", "summary": "s"}'),
        3: F.lit('{"headline": "H", "summary": "s", "topic": "zzz", "confidence": "sure"}'),
    }
    answer = F.lit("no answer")
    for k, shape in shapes.items():
        answer = F.when((F.col("turn") + n) % 4 == k, shape).otherwise(answer)
    return gates.parse_answers(t.raw("conversations").withColumn("answer", answer)).select("conv_id", "turn", "headline", "topic", "confidence", "valid")


@query("""WITH v AS (SELECT coalesce(CASE WHEN label % 3 > 0 THEN 'm' || (label % 3) END, '(n/a)') AS model FROM embeddings)
SELECT model, count(*) AS n, count(*) OVER () > 1 AS mixed FROM v GROUP BY 1""", plain=True)
def model_mix(t):
    return gates.model_mix(t.raw("embeddings").withColumn("model", F.when(F.col("label") % 3 > 0, F.concat(F.lit("m"), F.col("label") % 3))))


@query(" SELECT vec_id, len(embedding) AS dim FROM embeddings".replace(" SELECT", "SELECT", 1), plain=True)
def checked_vectors(t):
    v = t.raw("embeddings").withColumn("model", F.lit("m"))
    return similarity.check_dimension(gates.one_model(v), 64).select("vec_id", F.size("embedding").cast("long").alias("dim"))


LOCAL = "WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS local FROM events) "


@query(LOCAL + "SELECT event_id, 60 * hour(local) + minute(local) - 570 BETWEEN 0 AND 25 AS due, hour(local)::INT AS local_hour FROM l", plain=True)
def due_slots(t):
    return gates.due_slots(t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), 9, 30).select("event_id", "due", "local_hour")


@query(LOCAL + 'SELECT event_id, hour(local) >= 9 AND hour(local) < 21 AS "open", hour(local) = 9 AS morning FROM l', plain=True)
def publish_window(t):
    return gates.in_publish_window(t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))).select("event_id", "open", "morning")


@query(f""", o AS (SELECT cluster_id, list_sort(list(DISTINCT coalesce(nullif(owner_group, ''), source_id))) AS owners, list_sort(list(DISTINCT coalesce(nullif(owner_group, ''), source_id)) FILTER (id % 2 = 0)) AS early FROM members GROUP BY 1),
j AS (SELECT post_id, pub_min, list_sort([x FOR x IN owners IF NOT list_contains(coalesce(early, []), x)]) AS new_owners, post_id % 2 = 0 AS was, cluster_id % 3 = 0 AS now FROM posts JOIN o USING (cluster_id) WHERE pub_min IS NOT NULL)
SELECT post_id, new_owners, CASE WHEN pub_min < {AS_OF} - 2880 THEN 'frozen' WHEN len(new_owners) = 0 AND NOT (was AND NOT now) THEN 'unchanged' ELSE 'edited' END AS state, was AND now AS one_sided FROM j""")
def post_sync(t):
    own = t.members.groupBy("cluster_id").agg(F.array_sort(F.collect_set(S.owner())).alias("owners"), F.array_sort(F.collect_set(F.when(F.col("id") % 2 == 0, S.owner()))).alias("posted_owners"))
    posts = t.posts.where("pub_min IS NOT NULL").select("post_id", "cluster_id", "pub_min", (F.col("post_id") % 2 == 0).alias("was_one_sided"))
    posts = posts.join(own.select("cluster_id", "posted_owners"), "cluster_id")
    now = own.select("cluster_id", "owners", (F.col("cluster_id") % 3 == 0).alias("now_one_sided"))
    return gates.sync_state(posts, now, AS_OF).select("post_id", "new_owners", "state", "one_sided")


# ------------------------------------------------------------------ drafts

STEMS = ["the", "and", "est", "der"]


@query("WITH p AS (SELECT doc_id, text, regexp_matches(coalesce(text, ''), '(?i)the ') OR regexp_matches(coalesce(text, ''), '^A') AS hit FROM documents) SELECT doc_id, length(CASE WHEN hit THEN '' ELSE text END) AS n FROM p", plain=True)
def empty_phrases(t):
    return drafts.without_empty_phrases(t.raw("documents"), "text", ["(?i)the ", "^A"]).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f""" SELECT id, NOT ({hit_sql('title', STEMS)} AND NOT regexp_matches(title, '[:«»"]') AND id % 2 = 0) AS passed FROM articles WHERE title IS NOT NULL""")
def headline_gate(t):
    a = t.articles.where("title IS NOT NULL").select("id", F.col("title").alias("headline"), F.when(F.col("id") % 2 == 1, "lead").alias("lead"))
    return drafts.headline_substance(a, STEMS).select("id", "passed")


@query(f"WITH h AS (SELECT doc_id, {hit_sql('text', STEMS)} AS hit FROM documents) SELECT * FROM h", plain=True)
def stem_hits(t):
    return t.raw("documents").select("doc_id", drafts.hits(F.col("text"), STEMS).alias("hit"))


ROLES = f""", r AS (SELECT id, entity_id, fact AS role, title || ' ' || coalesce(summary, '') AS body, {words_sql('fact')} AS rw, {words_sql("title || ' ' || coalesce(summary, '')")} AS bw FROM articles JOIN facts ON fact_id = id),
s AS (SELECT *, [x[1:4] FOR x IN rw IF length(x) > 3] AS a, list_distinct([x[1:4] FOR x IN bw]) AS b FROM r),
g AS (SELECT id, entity_id, len(a) > 0 AND 2 * len([x FOR x IN a IF list_contains(b, x)]) >= len(a) AS in_text FROM s)"""


def _roles(t):
    f = t.facts.select(F.col("fact_id").alias("id"), "entity_id", F.col("fact").alias("role"))
    return t.articles.join(f, "id").select("id", "entity_id", "role", F.concat("title", F.lit(" "), F.coalesce("summary", F.lit(""))).alias("body"))


@query(ROLES + " SELECT id, in_text FROM g")
def role_in_text(t):
    return drafts.role_in_text(_roles(t)).select("id", "in_text")


@query(ROLES + """, p AS (SELECT id // 3 AS post_id, entity_id AS surface, CASE WHEN id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS salience, in_text FROM g)
SELECT post_id, count(*) FILTER (bad) = 0 AS passed, coalesce(list_sort(list(DISTINCT surface) FILTER (bad)), []) AS bare FROM (SELECT *, salience = 'primary' AND NOT in_text AND surface NOT IN ('e1', 'e2', 'e3') AS bad FROM p) GROUP BY 1""")
def role_gloss_gate(t):
    r = _roles(t).select(F.floor(F.col("id") / 3).alias("post_id"), F.col("entity_id").alias("surface"), F.when(F.col("id") % 2 == 0, "primary").otherwise("secondary").alias("salience"), "role", "body")
    return drafts.role_gloss(r, t.spark.createDataFrame([("e1",), ("e2",), ("e3",)], "surface string"))


@query(f""" SELECT fact_id, CASE WHEN trim(fact, ' ') <> '' AND NOT {hit_sql('fact', STEMS)} AND len(regexp_split_to_array(trim(fact, ' '), '\\s+')) <= 6 THEN trim(fact, ' ') END AS role, CASE WHEN fact_id % 3 = 0 THEN 'primary' ELSE 'secondary' END AS salience FROM facts""")
def cleaned_roles(t):
    rows = t.facts.select("fact_id", F.col("fact").alias("role"), F.when(F.col("fact_id") % 3 == 0, "primary").when(F.col("fact_id") % 3 == 1, "other").alias("salience"))
    return drafts.clean_roles(rows, STEMS).select("fact_id", "role", "salience")


ALLOWED = [("press", "role"), ("press", "evaluative"), ("agency", "role"), ("agency", "legal"), ("agency", "scale"), ("official", "role"), ("official", "classification")]
LEGAL = [("charged", "charged over", "", False), ("ruled", "cleared over", "by court", True)]
TIERED = f""", tiered AS (SELECT f.fact_id, f.entity_id, kind, topics, s.type AS tier, CASE WHEN kind = 'legal' AND f.fact_id % 4 = 0 THEN 'charged over ' || fact WHEN kind = 'legal' AND f.fact_id % 4 = 1 THEN 'cleared over ' || fact || ' by court'
  WHEN f.fact_id % 6 = 0 THEN fact || ' 12 million' WHEN f.fact_id % 7 = 0 THEN 'top ' || fact ELSE fact END AS fact, CASE WHEN f.fact_id % 3 = 0 THEN source ELSE '' END AS attribution, CASE WHEN f.fact_id % 11 > 0 THEN 'q' END AS quote, text
  FROM facts f JOIN documents ON doc_id = f.fact_id JOIN sources s ON s.id = source)"""


#: Stems of outcomes.
OUTCOMES = ["acquit", "ouat"]


def _tiered(t):
    # Only legal facts (ids of 3 modulo 5) ask for their source's text, in its scan.
    told = F.when(F.col("doc_id") % 5 == 3, drafts.hits(F.col("text"), OUTCOMES))
    d = t.raw("documents").select(F.col("doc_id").alias("fact_id"), "source", told.alias("told"))
    s = t.sources.select(F.col("id").alias("source"), F.col("type").alias("tier"))
    k, fact = F.col("fact_id"), F.col("fact")
    legal = F.col("kind") == "legal"
    made = F.when(legal & (k % 4 == 0), F.concat(F.lit("charged over "), fact)).when(legal & (k % 4 == 1), F.concat(F.lit("cleared over "), fact, F.lit(" by court")))
    made = made.when(k % 6 == 0, F.concat(fact, F.lit(" 12 million"))).when(k % 7 == 0, F.concat(F.lit("top "), fact)).otherwise(fact)
    rows = t.facts.select("fact_id", "entity_id", "fact", "kind", "topics").join(d, "fact_id").join(s, "source")
    return rows.select("fact_id", "entity_id", made.alias("fact"), "kind", "topics", "tier", "told", F.when(k % 3 == 0, F.col("source")).otherwise("").alias("attribution"), F.when(k % 11 > 0, "q").alias("quote"))


@query(TIERED + rf""", c AS (SELECT *, array_to_string({words_sql('fact')}, ' ') AS nf, array_to_string({words_sql('attribution')}, ' ') AS na, fact LIKE 'charged over _%' AS charged, fact LIKE 'cleared over _% by court' AS ruled FROM tiered)
SELECT fact_id, [x FOR x IN [CASE WHEN (tier, kind) NOT IN (('press','role'),('press','evaluative'),('agency','role'),('agency','legal'),('agency','scale'),('official','role'),('official','classification')) THEN 'kind' END,
  CASE WHEN length(fact) > 120 OR trim(fact, ' ') = '' THEN 'length' END, CASE WHEN regexp_matches(fact, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(top|number one|the (largest|richest|biggest)|el (mayor|más)|la (mayor|más))([^\p{{L}}\p{{N}}\p{{M}}_]|$)') THEN 'ranking' END,
  CASE WHEN regexp_matches(fact, '(?i)\d[\d.,]*\s*(million|billion|millones|€|\$)') THEN 'sums' END, CASE WHEN kind <> 'evaluative' AND {hit_sql('fact', ['anin', 'quel'])} THEN 'opinion' END, CASE WHEN {hit_sql('fact', ['some say'])} THEN 'vague' END,
  CASE WHEN kind = 'evaluative' AND (trim(attribution, ' ') = '' OR NOT contains(nf, na)) THEN 'attribution' END, CASE WHEN quote IS NULL THEN 'quote' END, CASE WHEN len(topics) = 0 THEN 'topics' END,
  CASE WHEN kind <> 'legal' AND {hit_sql('fact', ['then'])} THEN 'guilt' END, CASE WHEN kind = 'legal' AND NOT charged AND NOT ruled THEN 'legal' END, CASE WHEN kind = 'legal' AND charged AND {hit_sql('text', ['acquit', 'ouat'])} THEN 'outcome' END] IF x IS NOT NULL] AS failures FROM c""")
def fact_rule_gate(t):
    allowed = t.spark.createDataFrame(ALLOWED, "tier string, kind string")
    legal = t.spark.createDataFrame(LEGAL, "term string, head string, tail string, outcome boolean")
    return drafts.fact_rules(_tiered(t), allowed, ["anin", "quel"], ["some say"], guilt=["then"], legal=legal, whole=True).select("fact_id", "failures")


@query(TIERED + """ SELECT fact_id, CASE WHEN fact LIKE 'cleared over %' THEN 'ruled' ELSE 'charged' END AS term, CASE WHEN fact LIKE 'cleared over %' THEN trim(substring(fact, 14, strpos(substring(fact, 14), 'by court') - 1), ' ') ELSE trim(substring(fact, 14), ' ') END AS "case"
  FROM tiered WHERE fact LIKE 'charged over %' OR (fact LIKE 'cleared over %by court%')""")
def legal_phrases(t):
    return drafts.match_legal(_tiered(t).select("fact_id", "fact"), t.spark.createDataFrame([x[:3] for x in LEGAL], "term string, head string, tail string"))


@query(""", n AS (SELECT fact_id, fact, kind, string_split(fact, ' ') AS w FROM facts), c AS (SELECT fact_id, kind, CASE WHEN fact_id % 2 = 0 THEN upper(w[1][1]) || w[1][2:] || 'xy Smith — ' || fact ELSE fact END AS fact, CASE WHEN fact_id % 4 = 0 THEN w[1] || 'xy smith' ELSE 'nobody at all' END AS name, w FROM n WHERE regexp_matches(w[1], '^[a-z]{2,}$'))
SELECT fact_id, kind = 'role' AND fact_id % 4 = 2 AS other FROM c""")
def someone_else(t):
    w = F.split("fact", " ")[0]
    named = F.concat(F.upper(F.substring(w, 1, 1)), F.expr("substring(split(fact, ' ')[0], 2)"), F.lit("xy Smith — "), F.col("fact"))
    k = F.col("fact_id")
    rows = t.facts.where(w.rlike("^[a-z]{2,}$")).select("fact_id", "kind", F.when(k % 2 == 0, named).otherwise(F.col("fact")).alias("fact"), F.when(k % 4 == 0, F.concat(w, F.lit("xy smith"))).otherwise("nobody at all").alias("name"))
    return drafts.about_someone_else(rows).select("fact_id", "other")


@query(f"WITH q AS (SELECT doc_id, {words_sql('substring(text, 11, 40)')} AS q, array_to_string({words_sql('text')}, ' ') AS t FROM documents) SELECT doc_id, len(q) >= 4 AND contains(t, array_to_string(q, ' ')) AS found FROM q", plain=True)
def quotes_found(t):
    return t.raw("documents").select("doc_id", X.quote_found(F.substring("text", 11, 40), F.col("text")).alias("found"))


@query(TIERED + f""", q AS (SELECT *, {words_sql('CASE WHEN fact_id % 4 = 0 THEN reverse(substring(text, 11, 40)) ELSE substring(text, 11, 40) END')} AS qw, array_to_string({words_sql('text')}, ' ') AS tw, array_to_string({words_sql('fact')}, ' ') AS k FROM tiered),
v AS (SELECT *, length(fact) <= 60 AS ok, len(qw) >= 4 AND contains(tw, array_to_string(qw, ' ')) AS found FROM q),
r AS (SELECT *, CASE WHEN ok AND found THEN row_number() OVER (PARTITION BY ok AND found, entity_id, k ORDER BY fact_id) END AS rn FROM v)
SELECT fact_id, CASE WHEN rn = 1 THEN 'kept' WHEN rn > 1 THEN 'repeat' ELSE array_to_string([x FOR x IN [CASE WHEN NOT ok THEN 'length' END, CASE WHEN NOT found THEN 'unsourced' END] IF x IS NOT NULL], ',') END AS outcome FROM r""")
def verified_facts(t):
    """Every fourth quote is misquoted."""
    head = F.substring("text", 11, 40)
    quotes = t.raw("documents").select(F.col("doc_id").alias("fact_id"), F.when(F.col("doc_id") % 4 == 0, F.reverse(head)).otherwise(head).alias("quote"))
    rows = _tiered(t).drop("quote").join(quotes, "fact_id").select("fact_id", "entity_id", "fact", "quote", F.col("fact_id").alias("url"))
    sources = t.raw("documents").select(F.col("doc_id").alias("url"), "text")
    kept, rest = drafts.verify_batch(rows, sources, lambda c: c.withColumn("failures", gates.failures(length=F.length("fact") <= 60)))
    return kept.select("fact_id", F.lit("kept").alias("outcome")).unionByName(rest.select("fact_id", F.array_join("failures", ",").alias("outcome")))


GEO = [("north", "Outlet 1"), ("north", "Outlet 2"), ("south", "Outlet 3"), ("home", "Outlet 5")]


@query(""" SELECT id, CASE WHEN id % 4 <> 0 THEN CASE source_name WHEN 'Outlet 1' THEN 'north' WHEN 'Outlet 2' THEN 'north' WHEN 'Outlet 3' THEN 'south' WHEN 'Outlet 5' THEN 'home' END END AS geo_tag FROM members""")
def geo_tags(t):
    rows = t.members.select("id", F.col("source_name").alias("place"), F.when(F.col("id") % 4 == 0, "spain").when(F.col("id") % 4 == 1, "world").alias("scope"))
    return drafts.resolve_geo(rows, t.spark.createDataFrame(GEO, "tag string, alias string"))[0].select("id", "geo_tag")


@query(r"""WITH f AS (SELECT doc_id, text AS t FROM documents), a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}\p{M}_])the([^\p{L}\p{N}\p{M}_]|$)', '\1THE\2', 'g'), '(^|[^\p{L}\p{N}\p{M}_])the([^\p{L}\p{N}\p{M}_]|$)', '\1THE\2', 'g') AS t FROM f),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}\p{M}_])The([^\p{L}\p{N}\p{M}_]|$)', '\1THE\2', 'g'), '(^|[^\p{L}\p{N}\p{M}_])The([^\p{L}\p{N}\p{M}_]|$)', '\1THE\2', 'g') AS t FROM a) SELECT doc_id, md5(t) AS digest FROM b""", plain=True)
def fixed_names(t):
    return drafts.fix_names(t.raw("documents"), "text", [("the", "THE")]).select("doc_id", F.md5("text").alias("digest"))


@query(r""", w AS (SELECT id, summary, regexp_extract(summary, '^[^\p{L}]*\p{L}+[^\p{L}]+(\p{L}+)', 1) AS n FROM articles)
SELECT id, CASE WHEN n = '' THEN summary ELSE regexp_replace(summary, '(^|[^\p{L}\p{N}_])' || n || '([^\p{L}\p{N}_]|$)', '\1*' || n || '*\2') END AS text FROM w""")
def marked_names(t):
    texts = t.articles.select("id", F.col("summary").alias("text"))
    names = texts.select("id", F.regexp_extract("text", r"^[^\p{L}]*\p{L}+[^\p{L}]+(\p{L}+)", 1).alias("name")).where("name <> ''")
    return drafts.mark_first(texts, names)


@query(""" SELECT id, array_to_string([x FOR x IN [trim(coalesce(title, ''), ' '), trim(coalesce(summary, ''), ' '), CASE WHEN id % 3 = 0 THEN '' ELSE source_id END] IF x <> ''], chr(10) || chr(10)) AS body FROM articles WHERE source_id IS NOT NULL""")
def composed_bodies(t):
    rows = t.articles.where("source_id IS NOT NULL").select("id", "title", "summary", F.when(F.col("id") % 3 != 0, F.col("source_id")).alias("outlet"))
    return drafts.compose(rows, ["title", "summary", "outlet"]).select("id", "body")


@query(""", g AS (SELECT cluster_id, CASE WHEN type = 'official' THEN 9 WHEN type = 'agency' THEN 8 ELSE coalesce(lean_value, 0) END AS place, CASE WHEN type = 'official' THEN 'official' WHEN type = 'agency' THEN 'agency' ELSE coalesce(lean, 'center') END AS mark,
  list_sort(list(DISTINCT source_name)) AS names FROM members WHERE coalesce(url_canonical, '') <> '' GROUP BY 1, 2, 3)
SELECT cluster_id, string_agg(mark || ' ' || array_to_string(names, ' · '), ' · ' ORDER BY place, mark) AS sources FROM g GROUP BY 1""")
def source_lines(t):
    return drafts.source_lines(t.members)


@query(f""", p AS (SELECT id, title AS context, {words_sql('title')} AS w, {words_sql("coalesce(body, summary)")} AS fw FROM articles WHERE title IS NOT NULL),
f AS (SELECT id, context, [x FOR x IN w IF length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ('the', 'and') AND NOT list_contains([y[1:5] FOR y IN fw], x[1:5])] AS "foreign" FROM p)
SELECT id, "foreign", len("foreign") = 0 AND length(context) <= 60 AS ok FROM f""")
def foreign_words(t):
    rows = t.articles.where("title IS NOT NULL").select("id", F.col("title").alias("context"), F.array(F.coalesce("body", "summary")).alias("facts"))
    return entities.foreign_words(rows, ["the", "and"], 60).select("id", "foreign", "ok")


@query("""WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<link rel="alternate" type="application/rss+xml" href="' || url || '/feed">' ELSE '' END || html AS html FROM pages), t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(<link[^>]*>)', 1)) AS tag FROM h)
SELECT page_id, regexp_extract(tag, '(?i)href=["'']?([^"'' >]+)', 1) AS href FROM t WHERE regexp_matches(tag, '(?i)rel=["'']?alternate') AND regexp_matches(tag, '(?i)type=["'']?application/(rss|atom)\\+xml')""", plain=True)
def feed_links(t):
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="'), "url", F.lit('/feed">'))).otherwise("")
    return B.discover_feeds(t.raw("pages").withColumn("html", F.concat(head, "html")))


# ------------------------------------------------------------------ facts and names


@query(TIERED + f""" SELECT fact_id, CASE WHEN tier = 'press' AND kind IN ('evaluative', 'classification') AND NOT (attribution <> '' AND fact_id % 2 = 0) THEN 'candidate' ELSE 'active' END AS status, CASE WHEN kind = 'legal' THEN {AS_OF} + 43200 END AS expires_min,
  list_sort(list_distinct([x FOR x IN topics IF x IN ('t1', 't2', 't3')])) AS topics FROM tiered""")
def admitted_facts(t):
    rows = _tiered(t).withColumn("names", F.when(F.col("fact_id") % 2 == 0, F.concat(F.lit("Mr "), "attribution")).otherwise("x1 y2"))
    return entities.admit(rows, ["t1", "t2", "t3"], AS_OF).select("fact_id", "status", F.col("expires_min").cast("long").alias("expires_min"), "topics")


UNRESOLVED = f""", s AS (SELECT id, pub_min AS at_min, regexp_extract(title, '^[^\\p{{L}}]*([\\p{{L}}-]+)', 1) AS surface, CASE WHEN id % 3 = 0 THEN source_id END AS candidate FROM articles WHERE title IS NOT NULL),
k AS (SELECT *, {key_sql('surface')} AS key FROM s), q AS (SELECT key, count(*) AS n, min(at_min) AS first_min, max(at_min) AS last_min, arg_min(surface, (at_min, id)) AS spelling, arg_min(candidate, (at_min, id)) FILTER (candidate IS NOT NULL) AS candidate FROM k GROUP BY 1)"""


def _queue(t):
    word = F.regexp_extract("title", r"^[^\p{L}]*([\p{L}-]+)", 1)
    return entities.unresolved(t.articles.where("title IS NOT NULL").select("id", F.col("pub_min").alias("at_min"), word.alias("surface"), F.when(F.col("id") % 3 == 0, F.col("source_id")).alias("candidate")))


@query(UNRESOLVED + " SELECT * FROM q")
def unresolved_queue(t):
    return _queue(t)


@query(UNRESOLVED + " SELECT * FROM q WHERE key NOT LIKE 'a%' AND n >= 2 ORDER BY n DESC, key LIMIT 8")
def notify_queue(t):
    q = _queue(t)
    return entities.notify_queue(q, q.where("key LIKE 'a%'"), least=2)


@query(f""", a AS (SELECT DISTINCT entity_id, attribution FROM facts WHERE attribution IS NOT NULL AND substring(entity_id, 2)::INT % 3 > 0), f AS (SELECT entity_id, count(*) AS live_facts FROM facts WHERE status = 'active' AND (expires_min IS NULL OR expires_min > {AS_OF}) GROUP BY 1),
m AS (SELECT entity_id, count(*) AS mentions FROM taps GROUP BY 1), c AS (SELECT entity_id, count(*) AS aliases FROM a GROUP BY 1), e AS (SELECT entity_id FROM facts UNION SELECT entity_id FROM taps)
SELECT entity_id, coalesce(aliases, 0) AS aliases, coalesce(live_facts, 0) AS live_facts, coalesce(mentions, 0) AS mentions FROM e LEFT JOIN c USING (entity_id) LEFT JOIN f USING (entity_id) LEFT JOIN m USING (entity_id)""")
def entity_stats(t):
    """Every third entity has no alias."""
    everyone = t.facts.select("entity_id").unionByName(t.taps.select("entity_id"))
    aliases = t.facts.where("attribution IS NOT NULL AND cast(substring(entity_id, 2) AS int) % 3 > 0").select("entity_id", "attribution").distinct()
    return entities.entity_stats(everyone, aliases, t.facts, t.taps.groupBy("entity_id").agg(F.count("*").alias("mentions")), AS_OF)


@query(""", m AS (SELECT entity_id, count(*) AS mentions FROM taps GROUP BY 1) SELECT entity_id, mentions FROM m WHERE entity_id <> 'e7' AND entity_id NOT IN (SELECT entity_id FROM facts WHERE status = 'active' AND fact_id % 3 = 0) ORDER BY mentions DESC, entity_id LIMIT 5""")
def entities_without_pool(t):
    m = t.taps.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return entities.without_pool(m.select("entity_id", (F.col("entity_id") == "e7").alias("never_explain")), t.facts.where("fact_id % 3 = 0"), m)


@query(""", map AS (SELECT DISTINCT entity_id AS old_id, 'e' || (substring(entity_id, 2)::INT // 2) AS new_id FROM facts WHERE substring(entity_id, 2)::INT % 3 = 0),
a AS (SELECT DISTINCT coalesce(new_id, entity_id) AS entity_id, attribution FROM facts LEFT JOIN map ON old_id = entity_id WHERE attribution IS NOT NULL), m AS (SELECT coalesce(new_id, entity_id) AS entity_id, count(*) AS mentions FROM taps LEFT JOIN map ON old_id = entity_id GROUP BY 1)
SELECT entity_id, aliases, mentions FROM (SELECT entity_id, count(*) AS aliases FROM a GROUP BY 1) FULL JOIN m USING (entity_id)""")
def merged_entities(t):
    n = F.expr("cast(substring(entity_id, 2) AS int)")
    mapping = t.facts.where(n % 3 == 0).select(F.col("entity_id").alias("old_id"), F.concat(F.lit("e"), F.floor(n / 2)).alias("new_id")).distinct()
    aliases = t.facts.where("attribution IS NOT NULL").select("entity_id", "attribution").distinct()
    a, m = dedup.merge_entities(aliases, t.taps.groupBy("entity_id").agg(F.count("*").alias("mentions")), mapping)
    return a.groupBy("entity_id").agg(F.count("*").alias("aliases")).join(m, "entity_id", "full_outer").select("entity_id", "aliases", F.col("mentions").cast("long").alias("mentions"))


@query(f""", p AS (SELECT id AS post_id, pub_min, {key_sql('title')} AS h, id % 2 AS k FROM articles WHERE title IS NOT NULL AND id % 5 <> 0), n AS (SELECT DISTINCT 'e' || (id % 97) AS entity_id, id % 97 AS g FROM articles),
w AS (SELECT DISTINCT post_id, pub_min, k, unnest(string_split(h, ' ')) AS name FROM p), names AS (SELECT 'e' || min(post_id) AS entity_id, name FROM w WHERE length(name) >= 5 GROUP BY name)
SELECT entity_id, post_id FROM w JOIN names USING (name) WHERE pub_min >= {AS_OF} - 10080 AND NOT (k = 1 AND entity_id = 'e' || post_id) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY pub_min DESC, post_id) <= 3""")
def backfill_targets(t):
    a = t.articles.where("title IS NOT NULL AND id % 5 <> 0")
    words = a.select("id", F.explode(F.array_distinct(F.split(X.entity_key(F.col("title")), " "))).alias("name"))
    names = words.where("length(name) >= 5").groupBy("name").agg(F.concat(F.lit("e"), F.min("id")).alias("entity_id"))
    own = F.when(F.col("id") % 2 == 1, F.create_map(F.concat(F.lit("e"), "id"), F.lit("c"))).otherwise(F.create_map(F.lit("none"), F.lit("")))
    posts = a.select(F.col("id").alias("post_id"), F.col("title").alias("header"), "pub_min", own.alias("contexts"))
    return drafts.backfill_targets(posts, names, AS_OF, top=3)


@query(f""", p AS (SELECT post_id, pub_min, ['e' || (post_id % 40), 'e' || (cluster_id % 40)] AS e FROM posts WHERE pub_min >= {AS_OF} - 1440), c AS (SELECT list(DISTINCT entity_id) AS l FROM facts WHERE kind = 'legal' AND status = 'stale'),
h AS (SELECT post_id, list_sort(list_distinct([x FOR x IN e IF list_contains(l, x)])) AS changed, [x FOR x IN e IF NOT (list_contains(l, x) AND substring(x, 2)::INT % 2 = 1)] AS entity_ids FROM p, c)
SELECT post_id, changed, entity_ids, list_sort(list_distinct(entity_ids)) AS context_keys FROM h WHERE len(changed) > 0""")
def refresh_targets(t):
    """Entities of an odd number are deleted by now."""
    ids = F.array(F.concat(F.lit("e"), F.col("post_id") % 40), F.concat(F.lit("e"), F.col("cluster_id") % 40))
    context = F.map_from_entries(F.transform(F.array_distinct(ids), lambda e: F.struct(e, F.concat(F.lit("about "), e))))
    p = t.posts.select("post_id", "pub_min", ids.alias("entity_ids"), context.alias("entity_context"))
    alive = t.facts.where("cast(substring(entity_id, 2) AS int) % 2 = 0").select("entity_id")
    out = entities.refresh_targets(p, t.facts.where("kind = 'legal' AND status = 'stale'"), AS_OF, alive=alive)
    return out.select("post_id", "changed", "entity_ids", F.array_sort(F.map_keys("entity_context")).alias("context_keys"))


@query(" SELECT fact_id FROM facts ORDER BY md5('1:' || fact_id), fact_id LIMIT 5")
def audit_sample(t):
    return drafts.audit_sample(t.facts).select("fact_id")


# ------------------------------------------------------------------ stories, issues and sinks


@query(f""" SELECT id, body IS NOT NULL AND pub_min > {AS_OF} - 4320 AS has_body, e.vec_id IS NOT NULL AND pub_min >= {AS_OF} - 20160 AS has_vector, cluster_id FROM articles LEFT JOIN embeddings e ON vec_id = id""")
def retention(t):
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = B.retain(t.articles.join(v, "id", "left"), AS_OF)
    return out.select("id", F.col("body").isNotNull().alias("has_body"), F.col("embedding").isNotNull().alias("has_vector"), "cluster_id")


@query(""" SELECT id, vec_id IS NOT NULL AND id % 3 = 1 AS has_vector, CASE WHEN vec_id IS NOT NULL AND id % 3 = 1 THEN 'm1' WHEN vec_id IS NULL AND id % 3 > 0 THEN 'm' || (id % 3) END AS embed_model, CASE WHEN vec_id IS NULL OR id % 3 = 1 THEN cluster_id END AS cluster_id FROM articles LEFT JOIN embeddings ON vec_id = id""")
def dropped_models(t):
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    a = t.articles.join(v, "id", "left").withColumn("embed_model", F.when(F.col("id") % 3 > 0, F.concat(F.lit("m"), F.col("id") % 3)))
    return B.drop_model(a, "m1").select("id", F.col("embedding").isNotNull().alias("has_vector"), "embed_model", "cluster_id")


@query(f""" SELECT source_id AS feed, url_canonical AS url, trim(title, ' ') AS title, pub_min FROM articles WHERE source_id IS NOT NULL AND pub_min >= {AS_OF} - 2880 AND trim(title, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY source_id, url_canonical ORDER BY pub_min, trim(title, ' ')) = 1""")
def feed_rows(t):
    """Each article as its outlet's feed would send it, in turn as RSS, RDF and Atom, parsed back."""
    a = t.articles.where("source_id IS NOT NULL")
    ts = F.timestamp_seconds((F.col("pub_min") + 28401120) * 60)
    title = F.col("title")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(raw), F.lit(entity))
    rss = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), "url_canonical", F.lit("?utm_source=x</link><pubDate>Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><description>d</description></item></channel></rss>"))
    rdf = F.concat(F.lit('<rdf:RDF><item rdf:about="u"><title>'), title, F.lit("</title><link>"), "url_canonical", F.lit("</link><dc:date>"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</dc:date></item></rdf:RDF>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">'), title, F.lit('</title><link rel="self" href="http://other.example/"/><link href="'), "url_canonical", F.lit('"/><updated>'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00</updated></entry></feed>"))
    body = F.when(F.col("id") % 3 == 0, rss).when(F.col("id") % 3 == 1, rdf).otherwise(atom)
    return B.parse_feeds(a.select(F.col("source_id").alias("feed"), body.alias("body")), AS_OF).select("feed", "url", "title", "pub_min")


@query(""", best AS (SELECT cluster_id, source_id, CASE WHEN type = 'official' THEN 99 ELSE coalesce(lean_value, 0) END AS place FROM members GROUP BY ALL), l AS (SELECT cluster_id, list(source_id ORDER BY place, source_id) AS l FROM best GROUP BY 1),
p AS (SELECT cluster_id, CASE WHEN len(l) <= 3 THEN l ELSE [l[1], l[2 + (len(l) - 2) // 2], l[-1]] END AS p FROM l)
SELECT cluster_id, unnest(p) AS source_id, unnest(range(1, len(p) + 1))::INT AS pick FROM p""")
def spectrum_picks(t):
    return S.spectrum_picks(t.members, 3)


@query(SPECTRUM + LAST + f""", sizes AS (SELECT cluster_id, count(*) AS n_articles, count(DISTINCT source_id) AS n_sources FROM members GROUP BY 1), cand AS (SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'signup' ELSE 'sport' END AS topic, s.score, n_sources
  FROM spectrum s JOIN sizes USING (cluster_id) WHERE passes), recent AS (SELECT * FROM posts WHERE status = 'published' ORDER BY pub_min DESC, post_id DESC LIMIT 50),
bad AS (SELECT topic FROM (VALUES ('view', 0.1::DOUBLE), ('signup', 0.4::DOUBLE), ('sport', 0.2::DOUBLE)) c(topic, cap) WHERE (SELECT count(*) FROM recent) >= 12 AND (SELECT count(*) FROM recent WHERE lower(trim(category, ' ')) = topic) / (SELECT count(*) FROM recent) >= cap),
top AS (SELECT * FROM cand WHERE topic NOT IN (SELECT topic FROM bad) ORDER BY score DESC, cluster_id LIMIT 5),
q AS (SELECT greatest(0, 1000000 - count(*) FILTER (pub_min >= 41580 AND pub_min < 43020)) AS room, greatest(0, 3 - count(*) FILTER (with_sound AND pub_min >= 41760 AND pub_min < 43020)) AS loud_left, 43020 - max(pub_min) FILTER (pub_min < 43020) AS since FROM posts WHERE status = 'published'),
th AS (SELECT CASE WHEN count(*) >= 20 THEN quantile_cont(score, 0.95) END AS threshold FROM posts WHERE status = 'published' AND pub_min >= {AS_OF} - 43200),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, cluster_id) AS rn, CASE WHEN threshold IS NOT NULL THEN score >= threshold ELSE n_sources >= 5 END AS wants FROM top, q, th WHERE coalesce(since >= 0, true))
SELECT rn::INT AS rn, cluster_id, topic, round(score, 6) AS score, wants AND sum(wants::INT) OVER (ORDER BY rn) <= loud_left AS loud FROM r WHERE rn <= room""")
def admitted_run(t):
    size = t.members.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("n_sources"))
    topic = F.when(F.col("cluster_id") % 3 == 0, "view").when(F.col("cluster_id") % 3 == 1, "signup").otherwise("sport")
    c = S.spectrum(t.members, AS_OF).where("passes").join(size, "cluster_id").select("cluster_id", topic.alias("topic"), "score", "n_sources")
    topics = reports.topic_quota(t.posts, t.spark.createDataFrame([("view", 0.10), ("signup", 0.40), ("sport", 0.2)], "topic string, cap double"))
    state = reports.quota(t.posts, 43020, per_day=1_000_000)
    return issues.admit_run(c, topics, state, reports.score_percentile(t.posts, AS_OF), per_run=5, gap=0).select("rn", "cluster_id", "topic", *r6("score"), "loud")


# ------------------------------------------------------------------ similarity

VECTORS = """, v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, (vec_id * 7919) % 43200 AS pub_min, 'src' || (vec_id % 20) AS source_id FROM embeddings)"""


def _vectors(t):
    k = F.col("vec_id")
    return t.raw("embeddings").select(k.alias("id"), "label", "embedding", ((k * 7919) % 43200).alias("pub_min"), F.concat(F.lit("src"), k % 20).alias("source_id"), F.lit("all").alias("block"))


PAIRS = VECTORS + """, pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS sim, a.source_id AS source_a, b.source_id AS source_b, a.label = b.label AS same FROM v a JOIN v b ON a.id < b.id AND abs(a.pub_min - b.pub_min) <= 2880)"""


def _pairs(t, threshold):
    v = _vectors(t)
    side = lambda m: v.select(F.col("id").alias(m), F.col("source_id").alias(f"source_{m}"), F.col("label").alias(f"label_{m}"))
    return similarity.exact_pairs(v, threshold, hours=48).join(side("a"), "a").join(side("b"), "b")


@query(PAIRS + " SELECT a, b, round(sim, 5) AS sim FROM pairs WHERE sim >= 0.25")
def vector_pairs(t):
    return _pairs(t, 0.25).select("a", "b", F.round("sim", 5).alias("sim"))


@query(PAIRS + " SELECT a, b, round(sim, 5) AS sim, source_a, source_b FROM pairs WHERE abs(sim - 0.3) <= 0.05 AND source_a <> source_b AND (a + b) % 5 <> 0")
def border_pairs(t):
    p = _pairs(t, 0.25)
    labelled = p.where("(a + b) % 5 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return similarity.border_pairs(p, labelled, 0.3, 0.05).select("a", "b", F.round("sim", 5).alias("sim"), "source_a", "source_b")


@query(PAIRS + """, l AS (SELECT same, sim, greatest(29, least(95, floor(round(sim * 10000) / 100)))::INT AS c FROM pairs WHERE sim >= 0.25), g AS (SELECT c::INT AS c, (SELECT count(*) FROM l WHERE NOT same AND l.c < g.c) + (SELECT count(*) FROM l WHERE same AND l.c >= g.c) AS hits FROM range(30, 96) g(c)),
best AS (SELECT c, hits, row_number() OVER (ORDER BY c) AS rn, count(*) OVER () AS n FROM g WHERE hits = (SELECT max(hits) FROM g)), f AS (SELECT count(*) AS n_labels, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same) AS n_diff, min(sim) FILTER (same) AS lo, max(sim) FILTER (NOT same) AS hi FROM l)
SELECT CASE WHEN n_same > 0 AND n_diff > 0 THEN c / 100 END AS threshold, CASE WHEN n_same > 0 AND n_diff > 0 THEN round(hits / n_labels, 3) END AS accuracy, n_labels, n_same, n_diff, lo <= hi AS overlap FROM f, best WHERE rn = n // 2 + 1""")
def threshold_advice(t):
    return similarity.recommend_threshold(_pairs(t, 0.25).select((F.col("label_a") == F.col("label_b")).alias("same_story"), "sim"))


STORIES = VECTORS + """, s AS (SELECT id, id % 50 AS story, x, pub_min FROM v), u AS (SELECT story, unnest(x) AS x, unnest(range(64)) AS i FROM s), m AS (SELECT story, i, avg(x) AS m FROM u GROUP BY 1, 2), c AS (SELECT story AS cluster_id, list(m ORDER BY i) AS c FROM m GROUP BY 1),
st AS (SELECT story AS cluster_id, min(pub_min) AS first_min, max(pub_min) AS last_min FROM s GROUP BY 1)"""


def _stories(t):
    v = _vectors(t).withColumn("story", F.col("id") % 50)
    times = v.groupBy("story").agg(F.min("pub_min").alias("first_min"), F.max("pub_min").alias("last_min"))
    return v, similarity.centroids(v.select("story", "embedding"), "story").join(times, "story").withColumnRenamed("story", "cluster_id")


@query(STORIES + """, n AS (SELECT id, cluster_id, list_cosine_similarity(x, c.c) AS sim FROM s, c JOIN st USING (cluster_id) WHERE last_min >= pub_min - 2880 AND first_min <= pub_min + 2880)
SELECT id, cluster_id, round(sim, 5) AS sim FROM n WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster_id) = 1""")
def nearest_story(t):
    v, stories = _stories(t)
    return similarity.nearest_centroid(v, stories, 0.2).select("id", "cluster_id", F.round("sim", 5).alias("sim"))


@query(STORIES + f""", live AS (SELECT cluster_id FROM (SELECT post_id % 60 AS cluster_id, pub_min FROM posts WHERE status = 'published' AND message_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY post_id % 60 ORDER BY pub_min DESC, post_id DESC) = 1) WHERE cluster_id % 5 > 0 AND pub_min >= {AS_OF} - 172800),
r AS (SELECT a.cluster_id, b.cluster_id AS related_id, row_number() OVER (PARTITION BY a.cluster_id ORDER BY list_cosine_similarity(a.c, b.c) DESC, b.cluster_id) AS rank FROM c a JOIN c b ON a.cluster_id <> b.cluster_id AND (a.cluster_id + b.cluster_id) % 7 <> 0
  WHERE list_cosine_similarity(a.c, b.c) >= 0.1 AND b.cluster_id IN (SELECT cluster_id FROM live)), k AS (SELECT * FROM r WHERE rank <= 5 AND (cluster_id % 4 = related_id % 4 OR cluster_id % 3 = related_id % 3))
SELECT cluster_id, related_id, CASE WHEN cluster_id % 4 = related_id % 4 THEN 'topic' ELSE 'entity' END AS why FROM k QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY rank) = 1""")
def related_stories(t):
    """Stories whose number ends in 0 or 5 have no post, so nearer ones without a post must not take a place."""
    _, s = _stories(t)
    ids = s.select("cluster_id")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("b")
    blocked = ids.select(F.col("cluster_id").alias("a"), every).where("(a + b) % 7 = 0")
    posted = t.posts.withColumn("cluster_id", F.col("post_id") % 60).where("cluster_id % 5 > 0")
    facts = ids.select("cluster_id", F.concat(F.lit("t"), F.col("cluster_id") % 4).alias("topic"), F.array(F.concat(F.lit("e"), F.col("cluster_id") % 3)).alias("entity_ids"))
    return similarity.pick_related(similarity.related_stories(s, posted, blocked, AS_OF, 0.1), facts)


INDEXED = """WITH v AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS x FROM embeddings GROUP BY embedding)"""


def _index(t):
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("all").alias("block"))
    return VectorIndex.build(v, shared.folder(t.spark, "index"), lists=12)


@query(INDEXED + " SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 5) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.3", plain=True)
def index_pairs(t):
    """All pairs of representatives from the kept index."""
    return _index(t).pairs(0.3).withColumn("sim", F.round("sim", 5))


@query(INDEXED + " SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 5) AS sim FROM v a JOIN v b ON a.id <> b.id AND a.id % 100 = 0 WHERE list_cosine_similarity(a.x, b.x) >= 0.2", plain=True)
def index_within(t):
    """Half of the vectors are indexed, the rest inserted; every hundredth asks for all within 0.2."""
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("all").alias("block"))
    index = VectorIndex.build(v.where("id % 2 = 0"), shared.folder(t.spark, "index"), lists=12)
    index.insert(v.where("id % 2 = 1"))
    return index.within(v.where("id % 100 = 0"), 0.2).where("a <> b").withColumn("sim", F.round("sim", 5))


@query(""" SELECT e.vec_id AS id, v.id AS rep FROM embeddings e JOIN v ON v.x = e.embedding::DOUBLE[]""".replace(" SELECT", INDEXED + " SELECT", 1), plain=True)
def index_members(t):
    return _index(t).members


@query()
def restored_names(t):
    """Titles spelled in Cyrillic, and the Latin names that come back from the titles themselves."""
    titles = t.articles.where("title IS NOT NULL").select("id", F.initcap(F.lower("title")).alias("title"))
    posts = titles.select("id", F.initcap(entities.to_cyrillic(F.col("title"))).alias("text"))
    done = entities.restore_names(posts, entities.latin_names(titles, ["madrid"], ["El", "La"]))
    return done.select("id", F.sha2("text", 256).alias("text_sha256"), F.explode("restored").alias("r")).select("id", "r.name", "r.phrase", "text_sha256")


def _names(t):
    """Names: the second and third word of each benchmark item; aliases: their keys."""
    w = F.split("text", r"[ \n.,]+")
    return t.raw("benchmark").select(F.concat(F.lit("e"), "item_id").alias("entity_id"), F.concat_ws(" ", w[1], w[2]).alias("name"))


NAMES = rf""", nm AS (SELECT 'e' || item_id AS entity_id, concat_ws(' ', w[2], w[3]) AS name FROM (SELECT item_id, regexp_split_to_array(text, '[ \n.,]+') AS w FROM benchmark)),
keys AS (SELECT entity_id, {key_sql('name')} AS alias FROM nm)"""


@query(NAMES + rf""", single AS (SELECT entity_id, unnest(string_split(alias, ' ')) AS alias FROM keys), tokens AS (SELECT alias AS token, min(entity_id) AS entity_id FROM single GROUP BY 1),
sf AS (SELECT DISTINCT unnest({words_sql('title')}) AS surface FROM articles), s AS (SELECT surface, {key_sql('surface')} AS key FROM sf),
near AS (SELECT surface, entity_id, alias, levenshtein(key, alias) AS d FROM s JOIN single ON length(key) >= 5 AND length(alias) >= 5 AND abs(length(key) - length(alias)) <= 2)
SELECT surface, entity_id, 'exact' AS how FROM s JOIN tokens ON token = key
UNION ALL SELECT surface, entity_id, 'surname' FROM s JOIN tokens ON token = string_split(key, ' ')[-1] WHERE length(token) > 3
UNION ALL SELECT surface, entity_id, 'fuzzy' FROM (SELECT * FROM near WHERE d <= CASE WHEN length({key_sql('surface')}) < 8 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY surface ORDER BY d, entity_id, alias) = 1)""")
def alias_matching(t):
    """Exact, surname and fuzzy matches of words of the documents' titles against names; the fuzzy join loses no pair."""
    names = _names(t).select("entity_id", X.entity_key(F.col("name")).alias("alias"))
    words = t.articles.select(F.explode(X.words(F.col("title"))).alias("surface")).distinct()
    tag = lambda df, how: df.select("surface", "entity_id", F.lit(how).alias("how"))
    single = names.select("entity_id", F.explode(F.split("alias", " ")).alias("alias"))
    return tag(entities.match_exact(words, single), "exact").unionByName(tag(entities.match_surname(words, names), "surname")).unionByName(tag(entities.match_fuzzy(words, single), "fuzzy"))


@query(NAMES + f""", tx AS (SELECT id, pub_min, ' ' || array_to_string({words_sql('coalesce(body, summary)')}, ' ') || ' ' AS flat FROM articles)
SELECT entity_id, id, (row_number() OVER (PARTITION BY entity_id ORDER BY pub_min DESC, id))::INT AS rn FROM keys JOIN tx ON alias <> '' AND contains(flat, ' ' || alias || ' ') QUALIFY rn <= 5""")
def entity_mentions(t):
    texts = t.articles.select("id", "pub_min", F.coalesce("body", "summary").alias("text"))
    return entities.mentions(_names(t), texts)
