"""Operational reports and quotas: conditional aggregates over posts, runs, articles and outlets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import stories as S

DAY = 1440


def long_form(row: DataFrame, name: str = "metric") -> DataFrame:
    """One row of numbers as (metric, value) rows."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {pairs}) AS ({name}, value)")


def source_health(sources: DataFrame, articles: DataFrame, as_of: int, starved_share: float = 0.1, least: int = 10) -> DataFrame:
    """Articles, bodies and last arrival per outlet, those without any included; starved: enough articles, too few bodies."""
    a = articles.groupBy("source_id").agg(
        F.count("*").alias("n"), F.count("body").alias("bodies"), F.count_if(F.col("pub_min") >= as_of - DAY).alias("last_day"), F.max("pub_min").alias("last_min")
    )
    out = sources.join(a, sources.id == a.source_id, "left").select("id", "type", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bodies", "last_day")], "last_min")
    return out.withColumn("starved", (F.col("n") >= least) & (F.col("bodies") < starved_share * F.col("n")))


def daily_volume(articles: DataFrame, as_of: int, days: int = 14) -> DataFrame:
    """Articles and stories per day, today left out."""
    a = articles.withColumn("day", F.floor(F.col("pub_min") / DAY)).where((F.col("pub_min") < as_of - as_of % DAY) & (F.col("pub_min") >= as_of - as_of % DAY - days * DAY))
    return a.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("n_stories"))


def volume_gate(articles: DataFrame, as_of: int, today: int, days: int = 14, ratio: float = 0.4, least_days: int = 3) -> DataFrame:
    """Is today's volume at least `ratio` of the median day? Passes while there is little history."""
    v = daily_volume(articles, as_of, days).agg(F.count("*").alias("days"), F.percentile("n", F.lit(0.5)).alias("median"))
    return v.select("days", "median", F.lit(today).alias("today"), F.when(F.col("days") < least_days, True).otherwise(F.lit(today) >= ratio * F.col("median")).alias("passed"))


def feed_gate(runs: DataFrame, least: float = 0.7) -> DataFrame:
    v = runs.agg(F.coalesce(F.avg(F.col("feed_ok").cast("int")), F.lit(0.0)).alias("ratio"))
    return v.withColumn("passed", F.col("ratio") >= least)


def feed_status(runs: DataFrame) -> DataFrame:
    """Per outlet: the last success, the last attempt, whether that one succeeded, and the latest `etag` and `last_modified` that a fetch brought (if `runs` has them)."""
    latest = F.struct("run_min", "event_id")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), latest)).alias(c) for c in ("etag", "last_modified") if c in runs.columns]
    return runs.groupBy("source_id").agg(F.max(F.when(F.col("feed_ok"), F.col("run_min"))).alias("last_ok_min"), F.max("run_min").alias("last_min"), F.max_by("feed_ok", latest).alias("last_ok"), *kept)


def score_percentile(posts: DataFrame, as_of: int, p: float = 0.95, days: int = 30, least: int = 20) -> DataFrame:
    q = posts.where((F.col("status") == "published") & (F.col("pub_min") >= as_of - days * DAY))
    v = q.agg(F.count("*").alias("n"), F.percentile("score", F.lit(p)).alias("p"))
    return v.select("n", F.when(F.col("n") >= least, F.col("p")).alias("threshold"))


def quota(posts: DataFrame, as_of: int, per_day: int = 25, before_evening: int = 16, evening: int = 17) -> DataFrame:
    """Posts that may still go out: a rolling day, and before evening a reserve by calendar day."""
    p = posts.where("status = 'published'").agg(
        F.count_if((F.col("pub_min") >= as_of - DAY) & (F.col("pub_min") < as_of)).alias("used_24h"),
        F.count_if((F.col("pub_min") >= as_of - as_of % DAY) & (F.col("pub_min") < as_of)).alias("used_today"),
        F.count_if(F.col("with_sound") & (F.col("pub_min") >= as_of - as_of % DAY) & (F.col("pub_min") < as_of)).alias("loud_today"),
        F.max(F.when(F.col("pub_min") < as_of, F.col("pub_min"))).alias("last_min"),
    )
    room = per_day - F.col("used_24h")
    if (as_of % DAY) // 60 < evening:
        room = F.least(room, before_evening - F.col("used_today"))
    return p.select("used_24h", "used_today", F.greatest(F.lit(0), room).alias("room"), F.greatest(F.lit(0), 3 - F.col("loud_today")).alias("loud_left"), (as_of - F.col("last_min")).alias("minutes_since"))


def topic_quota(posts: DataFrame, caps: DataFrame, window: int = 50, least: int = 12) -> DataFrame:
    """Per capped topic: its share of the last posts, and whether it may go on; quiet while posts are few."""
    recent = posts.where("status = 'published'").orderBy(F.desc("pub_min"), F.desc("post_id")).limit(window)
    v = recent.groupBy().agg(F.count("*").alias("total"))
    same = recent.groupBy(F.lower(F.trim("category")).alias("topic")).agg(F.count("*").alias("same"))
    out = caps.join(same, "topic", "left").crossJoin(v).withColumn("same", F.coalesce("same", F.lit(0)))  # caps and one row
    return out.withColumn("ok", (F.col("total") < least) | (F.col("same") / F.greatest(F.col("total"), F.lit(1)) < F.col("cap")))


def owner_distribution(members: DataFrame, as_of: int, hours: int = 24) -> DataFrame:
    s = members.where(F.col("pub_min") >= as_of - 60 * hours).groupBy("cluster_id").agg(F.count_distinct(S.owner()).alias("o"))
    return s.agg(*[F.count_if(c).alias(n) for n, c in (("one", F.col("o") == 1), ("two", F.col("o") >= 2), ("three", F.col("o") >= 3), ("five", F.col("o") >= 5))])


def spectrum_report(members: DataFrame) -> DataFrame:
    s = members.groupBy("cluster_id").agg(
        F.count_distinct("source_id").alias("n"),
        F.bool_or(F.col("type") == "agency").alias("agency"),
        F.bool_or(F.col("lean") == "left").alias("l"),
        F.bool_or(F.col("lean") == "right").alias("r"),
        F.bool_or(F.col("lean_value") < 0).alias("lb"),
        F.bool_or(F.col("lean_value") > 0).alias("rb"),
        F.count_distinct("lean").alias("leans"),
    )
    tests = {
        "stories": F.lit(True), "two": F.col("n") >= 2, "three": F.col("n") >= 3, "five": F.col("n") >= 5, "three_agency": (F.col("n") >= 3) & F.col("agency"),
        "strict": F.col("l") & F.col("r"), "broad": F.col("lb") & F.col("rb"), "three_leans": F.col("leans") >= 3, "one_lean": F.col("leans") == 1,
    }
    return long_form(s.agg(*[F.count_if(c).alias(n) for n, c in tests.items()]))


def source_leaderboard(members: DataFrame, top: int = 8) -> DataFrame:
    """Outlets by the number of big stories (three outlets or more) that they wrote about."""
    big = members.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("n")).where("n >= 3")
    return members.join(big, "cluster_id", "left_semi").groupBy("source_name").agg(F.count_distinct("cluster_id").alias("stories")).orderBy(F.desc("stories"), "source_name").limit(top)


def health(articles: DataFrame, posts: DataFrame, runs: DataFrame, as_of: int) -> DataFrame:
    a = articles.agg(
        F.count("*").alias("articles"), F.max("pub_min").alias("newest_min"), F.count_if(F.col("pub_min") >= as_of - 60).alias("last_hour"),
        F.count_if(F.col("pub_min") >= as_of - DAY).alias("last_day"), F.count_if(F.col("cluster_id").isNull()).alias("no_story"), F.count_if(F.col("body").isNull()).alias("no_body"),
    )
    p = posts.agg(F.count_if(F.col("status") == "draft").alias("drafts"), F.count_if((F.col("status") == "published") & (F.col("pub_min") >= as_of - DAY)).alias("posts_day"))
    r = runs.agg(F.count_if(F.col("status") == "failed").alias("failed_runs"))
    return long_form(a.crossJoin(p).crossJoin(r))  # three single rows


def weekly_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy((F.floor(F.col("run_min") / (7 * DAY))).alias("week"), "status").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def weekly_ops(digests: DataFrame, runs: DataFrame, facts: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """(metric, value) of the last `days`: digests (created_min, status, item_count), runs by status with their tokens, and the fact pool."""
    since = as_of - days * DAY
    fresh = lambda c: F.col(c) >= since
    n = lambda ok, name: F.count_if(ok).cast("double").alias(name)
    d = digests.where(fresh("created_min")).agg(
        n(F.col("status") == "published", "digests_published"), n(F.col("status") == "skipped", "digests_skipped"),
        F.coalesce(F.avg(F.when(F.col("status") == "published", F.col("item_count"))), F.lit(0.0)).alias("average_items"),
    )
    r = runs.where(fresh("run_min")).agg(F.count("*").cast("double").alias("runs"), *[n(F.col("status") == x, f"runs_{x}") for x in ("ok", "halted", "failed")], F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("tokens"))
    f = facts.agg(*[n(F.col("status") == x, f"facts_{x}") for x in ("active", "candidate", "retired")], n(fresh("created_min"), "facts_added"), n((F.col("kind") == "legal") & (F.col("status") == "stale"), "legal_expired"))
    return long_form(d.crossJoin(r).crossJoin(f))  # three single rows


def weekly_taps(taps: DataFrame) -> DataFrame:
    return taps.groupBy((F.floor(F.col("tap_min") / (7 * DAY))).alias("week")).agg(F.count("*").alias("taps"), F.count_distinct("user_id").alias("users"), F.count_distinct("entity_id").alias("entities"))


def story_browser(members: DataFrame, top: int = 60) -> DataFrame:
    """Stories of two outlets or more, newest title and all outlets' names."""
    s = members.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"), F.max_by("title", F.struct("pub_min", "id")).alias("sample"), F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("outlets"), F.max("pub_min").alias("last_min")
    )
    return s.where("n_sources >= 2").orderBy(F.desc("n_sources"), F.desc("last_min"), "cluster_id").limit(top)


def volume_estimate(articles: DataFrame, chars_per_token: float = 3.41, price: float = 0.06) -> DataFrame:
    """Average text, articles a day, tokens and price a month."""
    v = articles.agg(F.avg(F.least(F.length("body"), F.lit(1500))).alias("chars"), (F.count("*") / ((F.max("pub_min") - F.min("pub_min")) / DAY)).alias("per_day"))
    tokens = F.col("chars") / chars_per_token * F.col("per_day") * 30
    return v.select("chars", "per_day", tokens.alias("tokens_month"), (tokens / 1e6 * price).alias("price_month"))


def feed_profile(articles: DataFrame, as_of: int) -> DataFrame:
    """Per outlet: entries, last day's, age of the newest, median length, what the feed carries, and a verdict."""
    v = articles.groupBy("source_id").agg(F.count("*").alias("entries"), F.count_if(F.col("pub_min") >= as_of - DAY).alias("last_day"), ((as_of - F.max("pub_min")) / 60).alias("newest_h"), F.percentile("n_chars", F.lit(0.5)).alias("median_chars"))
    carries = F.when(F.col("median_chars") >= 1500, "full").when(F.col("median_chars") >= 200, "summary").otherwise("title")
    verdict = F.when(F.col("newest_h") > 72, "FAIL").when((F.col("newest_h") > 24) | (F.col("last_day") == 0), "WARN").otherwise("OK")
    return v.select("*", carries.alias("carries"), verdict.alias("verdict"))


def best_feed(profiles: DataFrame, group: str) -> DataFrame:
    """The best feed of a group: verdict, then last day's entries, then length."""
    rank = F.when(F.col("verdict") == "OK", 0).when(F.col("verdict") == "WARN", 1).otherwise(2)
    w = Window.partitionBy(group).orderBy(rank, F.desc("last_day"), F.desc("median_chars"), "source_id")
    return profiles.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rare_words(posts: DataFrame, most: int = 2, least_chars: int = 5) -> DataFrame:
    """Words of at least five letters that occur at most twice in all posts, with the first post."""
    w = posts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).where(F.length("word") >= least_chars)
    return w.groupBy("word").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") <= most)


def group_by_category(items: DataFrame, least: int = 2) -> DataFrame:
    """Items with their group: small or missing categories fall into 'other', which comes last."""
    n = F.count("*").over(Window.partitionBy("issue", "category"))
    group = F.when(F.col("category").isNull() | (n < least), "other").otherwise(F.col("category"))
    return items.withColumn("grp", group).withColumn("grp_order", F.when(F.col("grp") == "other", 1).otherwise(0))


def top_posts(posts: DataFrame, as_of: int, hours: int = 24, top: int = 3) -> DataFrame:
    p = posts.where((F.col("status") == "published") & (F.col("pub_min") >= as_of - 60 * hours))
    return p.orderBy(F.desc("score"), "post_id").limit(top)


def rate_audit(events: DataFrame, most: int) -> DataFrame:
    """Per user: the most events in any trailing hour, and how often the limit was passed."""
    w = Window.partitionBy("user_id").orderBy("tap_min").rangeBetween(-59, 0)
    return events.withColumn("n", F.count("*").over(w)).groupBy("user_id").agg(F.max("n").alias("peak"), F.count_if(F.col("n") > most).alias("over"))


def waiting_outlets(posts: DataFrame, members: DataFrame) -> DataFrame:
    """Published posts of stories that have gained outlets since."""
    now = members.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("now_sources"))
    p = posts.where("status = 'published'").join(now, "cluster_id")
    return p.select("post_id", "cluster_id", "n_at_publish", "now_sources", (F.col("now_sources") - F.col("n_at_publish")).alias("waiting")).where("waiting > 0")


def hit_leaderboard(posts: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """Outlets by hits in published posts: a hit for every post and article of its story, as the fan-out means it."""
    p = posts.where("status = 'published'").groupBy("cluster_id").agg(F.count("*").alias("k"))
    m = members.groupBy("cluster_id", "source_name").agg(F.count("*").alias("a"))
    return m.join(p, "cluster_id").groupBy("source_name").agg(F.sum(F.col("k") * F.col("a")).alias("hits")).orderBy(F.desc("hits"), "source_name").limit(top)
