"""Logical news tables over the supplied Parquet tables, as Spark frames and as DuckDB CTEs.

Times are kept as whole minutes since 2024-01-01 UTC (`pub_min`, `AS_OF`), so that both engines
compute ages exactly. `Tables` reads lazily; unused columns never leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31 00:00 as minutes.
AS_OF = 30 * 1440
#: Fixed scale of political leanings, left to right.
LEANS = ["far-left", "left", "center-left", "center", "center-right", "right", "far-right"]


def lean_value(lean):
    """-3 .. 3, null for an unknown label."""
    return F.expr("CASE " + " ".join(f"WHEN {{0}} = '{x}' THEN {i - 3}" for i, x in enumerate(LEANS)).format(lean) + " END")


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        k = F.substring("source", 4, 9).cast("int")
        kind = F.when(k % 10 == 8, "agency").when(k % 10 == 9, "official").otherwise("press")
        return self.raw("documents").select("source").distinct().where("source IS NOT NULL").select(
            F.col("source").alias("id"),
            F.concat(F.lit("Outlet "), k).alias("name"),
            F.element_at(F.array(*map(F.lit, LEANS)), k % 7 + 1).alias("lean"),
            (k % 7 - 3).alias("lean_value"),
            kind.alias("type"),
            F.when(k % 11 == 10, F.lit("")).otherwise(F.concat(F.lit("own"), F.floor(k / 2).cast("int"))).alias("owner_group"),
            (1.0 + 0.1 * (k % 3)).cast("double").alias("weight"),
            F.when(k == 19, "disabled").otherwise("active").alias("status"),
            F.when(k % 6 == 5, "").otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.com/rss"))).alias("feed_url"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        d = self.raw("documents")
        e = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
        pub = (F.col("doc_id") * 7919) % 43200
        return d.join(e, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("source_id"),
            F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 80)).alias("title"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id") % 997).alias("url_canonical"),
            F.substring("text", 1, 120).alias("summary"),
            F.when(F.col("n_chars") >= 400, F.col("text")).alias("body"),
            "lang",
            "n_chars",
            pub.alias("pub_min"),
            F.when(F.col("label").isNotNull(), F.col("label") * 100 + F.floor(pub / 2880)).cast("bigint").alias("cluster_id"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Articles in a story, with their outlet; the outlet dimension is small by nature and is broadcast while it stays so."""
        s = self.sources.select(F.col("id").alias("source_id"), "lean", "lean_value", "type", "owner_group", "weight", F.col("name").alias("source_name"))
        return self.articles.where("cluster_id IS NOT NULL").join(s, "source_id")

    @cached_property
    def clusters(self) -> DataFrame:
        a = self.articles.where("cluster_id IS NOT NULL")
        return a.groupBy("cluster_id").agg(
            F.min("pub_min").alias("first_min"), F.max("pub_min").alias("last_min"), F.count("*").alias("n_articles"), F.count_distinct("source_id").alias("n_sources")
        )

    @cached_property
    def posts(self) -> DataFrame:
        e = self.raw("events").where("event_type IN ('purchase', 'signup', 'view')")
        minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - 28401120
        status = F.when(F.col("event_id") % 50 == 0, "draft").when(F.col("event_id") % 50 == 1, "skipped").otherwise("published")
        return e.select(
            F.col("event_id").alias("post_id"),
            ((F.col("event_id") % 10) * 100 + F.floor(minute / 2880)).cast("bigint").alias("cluster_id"),
            F.col("event_type").alias("category"),
            F.col("value").alias("score"),
            status.alias("status"),
            F.when(F.col("event_id") % 50 != 0, minute).cast("bigint").alias("pub_min"),
            (F.col("event_id") % 7 == 0).alias("with_sound"),
            (F.col("event_id") % 5).cast("bigint").alias("n_at_publish"),
            F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("message_id"),
        )

    @cached_property
    def taps(self) -> DataFrame:
        minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - 28401120
        return self.raw("events").where("event_type = 'click'").select(
            "event_id", "user_id", F.concat(F.lit("e"), F.col("event_id") % 40).alias("entity_id"), minute.cast("bigint").alias("tap_min")
        )

    @cached_property
    def runs(self) -> DataFrame:
        minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - 28401120
        return self.raw("events").where("event_type = 'error'").select(
            "event_id", F.element_at(F.array(F.lit("ok"), F.lit("failed"), F.lit("halted")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"),
            (F.col("value") * 100).cast("bigint").alias("tokens"), (F.col("event_id") % 4 != 0).alias("feed_ok"), minute.cast("bigint").alias("run_min"), F.concat(F.lit("src"), F.col("event_id") % 20).alias("source_id"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Facts about 40 entities: six words spread evenly over each document's whole text, with the outlet's bucket; null for a text without words."""
        d = self.raw("documents").where("text IS NOT NULL")
        s = self.sources.select(F.col("id").alias("source"), "lean_value", "type")
        # Blanks part faster than a pattern does; what they leave empty is no word.
        plain = F.replace(F.replace(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), F.lit("."), F.lit(" ")), F.lit(","), F.lit(" "))
        words = F.array_remove(F.split(plain, " "), "")
        # The words are bound by a lambda and the fact is exploded: else a filter on the fact is pushed below it and the text is split for every word and mention.
        spread = lambda w: F.when(F.size(w) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.get(w, F.floor(i * F.size(w) / 6).cast("int"))), " "))
        d = d.select("doc_id", "source", F.explode(F.transform(F.array(words), spread)).alias("_fact"))
        kinds = F.array(*map(F.lit, ["role", "classification", "scale", "legal", "evaluative"]))
        states = F.array(*map(F.lit, ["active", "candidate", "active", "stale", "retired", "candidate"]))
        bucket = F.when(F.col("type") != "press", "").when(F.col("lean_value") <= -1, "left").when(F.col("lean_value") >= 1, "right").otherwise("center")
        return d.join(s, "source").select(
            F.col("doc_id").alias("fact_id"),
            F.concat(F.lit("e"), F.col("doc_id") % 40).alias("entity_id"),
            F.col("_fact").alias("fact"),
            F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"),
            F.element_at(states, (F.col("doc_id") % 6 + 1).cast("int")).alias("status"),
            bucket.alias("bucket"),
            F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("attribution"),
            F.array(F.concat(F.lit("t"), F.col("doc_id") % 4), F.concat(F.lit("t"), F.col("doc_id") % 7)).alias("topics"),
            F.when(F.col("doc_id") % 5 == 3, (F.col("doc_id") * 7919) % 43200 + 43200 * (F.col("doc_id") % 2)).alias("expires_min"),
        )


#: The same tables for DuckDB; a query's SQL follows after a comma or as the final SELECT.
CTES = """WITH sources AS (
  SELECT source AS id, 'Outlet ' || k AS name,
    (['far-left','left','center-left','center','center-right','right','far-right'])[k % 7 + 1] AS lean, k % 7 - 3 AS lean_value,
    CASE WHEN k % 10 = 8 THEN 'agency' WHEN k % 10 = 9 THEN 'official' ELSE 'press' END AS type,
    CASE WHEN k % 11 = 10 THEN '' ELSE 'own' || (k // 2) END AS owner_group, (1.0 + 0.1 * (k % 3))::DOUBLE AS weight,
    CASE WHEN k = 19 THEN 'disabled' ELSE 'active' END AS status,
    CASE WHEN k % 6 = 5 THEN '' ELSE 'https://' || source || '.example.com/rss' END AS feed_url
  FROM (SELECT DISTINCT source, substring(source, 4)::INT AS k FROM documents WHERE source IS NOT NULL)
), articles AS (
  SELECT doc_id AS id, source AS source_id, trim(substring(string_split(text, chr(10))[1], 1, 80), ' ') AS title,
    'https://' || source || '.example.com/' || (doc_id % 997) AS url_canonical, substring(text, 1, 120) AS summary,
    CASE WHEN n_chars >= 400 THEN text END AS body, lang, n_chars, (doc_id * 7919) % 43200 AS pub_min,
    label * 100 + ((doc_id * 7919) % 43200) // 2880 AS cluster_id
  FROM documents LEFT JOIN (SELECT vec_id AS doc_id, label FROM embeddings) USING (doc_id)
), members AS (
  SELECT a.*, s.lean, s.lean_value, s.type, s.owner_group, s.weight, s.name AS source_name
  FROM articles a JOIN sources s ON a.source_id = s.id WHERE cluster_id IS NOT NULL
), clusters AS (
  SELECT cluster_id, min(pub_min) AS first_min, max(pub_min) AS last_min, count(*) AS n_articles, count(DISTINCT source_id) AS n_sources
  FROM articles WHERE cluster_id IS NOT NULL GROUP BY 1
), ev AS (
  SELECT *, epoch_us(ts) // 60000000 - 28401120 AS m FROM events
), posts AS (
  SELECT event_id AS post_id, (event_id % 10) * 100 + m // 2880 AS cluster_id, event_type AS category, value AS score,
    CASE WHEN event_id % 50 = 0 THEN 'draft' WHEN event_id % 50 = 1 THEN 'skipped' ELSE 'published' END AS status,
    CASE WHEN event_id % 50 <> 0 THEN m END AS pub_min, event_id % 7 = 0 AS with_sound, event_id % 5 AS n_at_publish,
    CASE WHEN event_id % 3 <> 0 THEN event_id END AS message_id
  FROM ev WHERE event_type IN ('purchase', 'signup', 'view')
), taps AS (
  SELECT event_id, user_id, 'e' || (event_id % 40) AS entity_id, m AS tap_min FROM ev WHERE event_type = 'click'
), runs AS (
  SELECT event_id, (['ok','failed','halted'])[event_id % 3 + 1] AS status, floor(value * 100)::BIGINT AS tokens, event_id % 4 <> 0 AS feed_ok,
    m AS run_min, 'src' || (event_id % 20) AS source_id FROM ev WHERE event_type = 'error'
), facts AS (
  SELECT doc_id AS fact_id, 'e' || (doc_id % 40) AS entity_id,
    array_to_string([ws[i * len(ws) // 6 + 1] FOR i IN range(6)], ' ') AS fact,
    (['role','classification','scale','legal','evaluative'])[doc_id % 5 + 1] AS kind,
    (['active','candidate','active','stale','retired','candidate'])[doc_id % 6 + 1] AS status,
    CASE WHEN s.type <> 'press' THEN '' WHEN lean_value <= -1 THEN 'left' WHEN lean_value >= 1 THEN 'right' ELSE 'center' END AS bucket,
    CASE WHEN doc_id % 3 <> 0 THEN source END AS attribution, ['t' || (doc_id % 4), 't' || (doc_id % 7)] AS topics,
    CASE WHEN doc_id % 5 = 3 THEN (doc_id * 7919) % 43200 + 43200 * (doc_id % 2) END AS expires_min
  FROM (SELECT *, [w FOR w IN regexp_split_to_array(lower(text), '[ \\n.,]+') IF w <> ''] AS ws FROM documents) d JOIN sources s ON d.source = s.id WHERE text IS NOT NULL
)"""


def oracle(body: str) -> str:
    """DuckDB SQL over the logical tables; a body that starts with a comma adds CTEs of its own."""
    return CTES + "\n" + body.strip()
