"""Quality gates: rows with an array of failures, and reports that add them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as X


def failures(**checks: Column) -> Column:
    """Names of the checks that do not hold, in the order given."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def cut_off(c: Column) -> Column:
    """Does a text end without a closing mark?"""
    return ~F.rtrim(F.coalesce(c, F.lit(""))).rlike(r"[.!?…»\")]$")


def issue_fields(items: DataFrame, most_sentences: int = 4) -> DataFrame:
    """Item fields of an issue: headline, summary and context there, short enough, not cut off, with links."""
    s = F.col("summary")
    return items.withColumn(
        "failures",
        failures(headline=~blank(F.col("headline")), summary=~blank(s), context=~blank(F.col("context")), sentences=X.count_sentences(s) <= most_sentences, ending=~cut_off(s), links=F.size("links") >= 1),
    )


def post_fields(posts: DataFrame, most_chars: int = 120, most_sentences: int = 4) -> DataFrame:
    """Post fields: a headline without final dot and not too long; a cut-off text fails only with several sentences."""
    h, t = F.trim(F.coalesce("headline", F.lit(""))), F.col("text")
    return posts.withColumn(
        "failures",
        failures(headline=h != "", dot=~h.endswith("."), length=F.length(h) <= most_chars, sentences=X.count_sentences(t) <= most_sentences, ending=(X.count_sentences(t) <= 1) | ~cut_off(t)),
    )


def link_diversity(items: DataFrame, least: int = 2) -> DataFrame:
    ids = F.transform("links", lambda x: x["source_id"])
    return items.withColumn("passed", (F.size("links") >= least) & (F.size(F.array_distinct(ids)) == F.size("links")))


def link_status(links: DataFrame, status: DataFrame, below: int = 400, tolerated: tuple = (403, 429)) -> DataFrame:
    """Per item: every link known and answered well; an item without a link is no row here and fails elsewhere."""
    ok = (F.col("code") > 0) & ((F.col("code") < below) | F.col("code").isin(*tolerated))
    return links.join(status, "url", "left").groupBy("item_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("passed"), F.count("*").alias("n_links"))


def post_rules(posts: DataFrame, last: DataFrame, tags: DataFrame, as_of: int, gap_hours: int = 12) -> DataFrame:
    """Scope, geo tag, one-sided note, republication gap and admission of drafts (post_id, cluster_id, scope, geo_tag, one_sided, note, passes)."""
    p = posts.join(tags.select(F.col("tag").alias("geo_tag"), F.lit(True).alias("_known")), "geo_tag", "left").join(last.select("cluster_id", F.col("pub_min").alias("_last")), "cluster_id", "left")
    checks = failures(
        scope=F.coalesce(F.col("scope") != "world", F.lit(True)),
        geo_tag=F.col("geo_tag").isNull() | F.col("_known"),
        one_sided=~F.coalesce("one_sided", F.lit(False)) | ~blank(F.col("note")),
        gap=F.col("_last").isNull() | (as_of - F.col("_last") >= 60 * gap_hours),
        rule=F.col("passes"),
    )
    return p.withColumn("failures", checks).drop("_known", "_last")


def report(checks: DataFrame) -> DataFrame:
    """Gate reports from (item_id, name, passed, detail): all passed, and the failures as 'name: detail; ...'."""
    bad = F.filter(F.array_sort(F.collect_list(F.struct("name", "passed", "detail"))), lambda c: ~c["passed"])
    lines = F.array_join(F.transform(bad, lambda c: F.concat(c["name"], F.lit(": "), c["detail"])), "; ")
    return checks.groupBy("item_id").agg(F.bool_and("passed").alias("passed"), lines.alias("reason"))


def parse_answers(raw: DataFrame) -> DataFrame:
    """JSON objects found in answers, fenced or not: fields checked, enumerations put right, and whether the row is valid."""
    body = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    x = raw.withColumn("_j", F.from_json(body, "headline string, summary string, topic string, confidence string", {"mode": "PERMISSIVE"}))
    topics = ["politics", "economy", "society", "world"]
    topic = F.when(F.lower("_j.topic").isin(*topics), F.lower("_j.topic")).otherwise("society")
    confidence = F.when(F.col("_j.confidence").isin("high", "medium", "low"), F.col("_j.confidence")).otherwise("high")
    ok = ~blank(F.col("_j.headline")) & ~blank(F.col("_j.summary")) & (F.length("_j.headline") <= 200)
    return x.select(*raw.columns, F.col("_j.headline").alias("headline"), F.col("_j.summary").alias("summary"), topic.alias("topic"), confidence.alias("confidence"), F.coalesce(ok, F.lit(False)).alias("valid"))


def model_mix(vectors: DataFrame) -> DataFrame:
    """Counts per embedding model; more than one row means that vectors must not be compared."""
    v = vectors.groupBy(F.coalesce("model", F.lit("(n/a)")).alias("model")).agg(F.count("*").alias("n"))
    return v.withColumn("mixed", F.count("*").over(Window.partitionBy(F.lit(1))) > 1)  # a row per model


def one_model(vectors: DataFrame) -> DataFrame:
    """`vectors`, or an error as soon as they are read when they come from more than one model."""
    mix = model_mix(vectors).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("model")).alias("names"))  # a row per model
    ok = F.when(F.col("n") <= 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("vectors of several models: "), F.array_join("names", ", "))))
    return vectors.crossJoin(mix.select(ok.alias("_ok"))).where("_ok").drop("_ok")  # a single row


def due_slots(instants: DataFrame, hour: int, minute: int, tolerance: int = 25, zone: str = "Europe/Madrid") -> DataFrame:
    """Is an instant (UTC timestamp `ts`) at most `tolerance` minutes after the local slot?"""
    local = F.from_utc_timestamp("ts", zone)
    late = F.hour(local) * 60 + F.minute(local) - (60 * hour + minute)
    return instants.withColumn("due", (late >= 0) & (late <= tolerance)).withColumn("local_hour", F.hour(local))


def in_publish_window(instants: DataFrame, first: int = 9, last: int = 21, zone: str = "Europe/Madrid") -> DataFrame:
    h = F.hour(F.from_utc_timestamp("ts", zone))
    return instants.withColumn("open", (h >= first) & (h < last)).withColumn("morning", h == first)


def edit_candidates(posts: DataFrame, pending: DataFrame, as_of: int, hours: int = 12) -> DataFrame:
    """Published posts young enough to be edited and without an edit under way."""
    p = posts.where((F.col("status") == "published") & (F.col("pub_min") >= as_of - 60 * hours) & (F.col("pub_min") <= as_of))
    return p.join(pending.select("post_id").distinct(), "post_id", "left_anti")


def sync_state(posts: DataFrame, owners_now: DataFrame, as_of: int, window_hours: int = 48) -> DataFrame:
    """frozen, unchanged or edited per post, with the owners that joined its story; one-sidedness can only go, and its going alone is an edit."""
    j = posts.join(owners_now, "cluster_id")
    new = F.array_sort(F.array_except("owners", "posted_owners"))
    state = F.when(F.col("pub_min") < as_of - 60 * window_hours, "frozen").when((F.size(new) == 0) & ~(F.col("was_one_sided") & ~F.col("now_one_sided")), "unchanged").otherwise("edited")
    return j.withColumn("new_owners", new).withColumn("state", state).withColumn("one_sided", F.col("was_one_sided") & F.col("now_one_sided"))
