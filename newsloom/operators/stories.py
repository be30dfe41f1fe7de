"""Story features, admission, scores, repeats, expiry and diverse picks.

Inputs are member rows (cluster_id, id, source_id, lean_value, type, owner_group, weight, title, body, pub_min);
times are minutes and `as_of` is a parameter. Every aggregate combines map-side; picks are bounded windows
per story with a rank filter, which Spark prunes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed title patterns of service pages: lotteries, horoscopes, result checks.
JUNK_TITLES = (
    r"(?i)\b(loter[íi]a|sorteo|bonoloto|primitiva|quiniela|euromillones|eurodreams)\b",
    r"(?i)\bcup[óo]n\b",
    r"(?i)\bhor[óo]scopo\b",
    r"(?i)comprobar.*(resultado|sorteo|n[úu]mero)",
    r"(?i)\b(el gordo|la grossa)\b",
)


def owner() -> Column:
    """The owner group, else the outlet itself; an empty group counts as missing."""
    return F.coalesce(F.nullif(F.col("owner_group"), F.lit("")), F.col("source_id"))


def political() -> Column:
    return ~F.col("type").isin("agency", "official")


def bucket(value: str | Column = "lean_value") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v <= -1, "left").when(v >= 1, "right").when(v.isNotNull(), "center")


#: The branches of the admission rule, any of which admits a story.
BRANCHES = ("left_and_right", "side_and_center", "min_sources")


def spectrum(members: DataFrame, as_of: int, w_span: float = 1.5, half_life_hours: float = 12, min_owners: int = 3, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """Per story: owners, political owners, span, buckets, admission by the named branches, one-sidedness and the spectrum score."""
    p, v = political(), F.col("lean_value")
    has = lambda b: F.coalesce(F.bool_or(p & (bucket() == b)), F.lit(False))
    out = members.groupBy("cluster_id").agg(
        F.count_distinct(owner()).alias("n_owners"),
        F.count_distinct(F.when(p, owner())).alias("n_political"),
        F.coalesce(F.max(F.when(p, v)) - F.min(F.when(p, v)), F.lit(0)).alias("span"),
        has("left").alias("has_left"),
        has("center").alias("has_center"),
        has("right").alias("has_right"),
        F.min("pub_min").alias("first_min"),
    )
    sides = F.col("has_left").cast("int") + F.col("has_center").cast("int") + F.col("has_right").cast("int")
    left, center, right = F.col("has_left"), F.col("has_center"), F.col("has_right")
    rules = {"left_and_right": left & right, "side_and_center": (left | right) & center, "min_sources": F.col("n_political") >= min_owners}
    passes = F.lit(False)
    for name in branches:
        passes = passes | rules[name]
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("first_min")) / 60)
    score = (F.col("n_owners") + w_span * F.col("span")) * F.pow(F.lit(2.0), -age / half_life_hours)
    return out.select("*", passes.alias("passes"), (sides == 1).alias("one_sided"), score.alias("score"))


def features(members: DataFrame, as_of: int, velocity_hours: int = 6) -> DataFrame:
    """Counts behind the linear rank; lean spread counts every outlet, political or not."""
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("n_articles"),
        F.count_distinct("source_id").alias("n_sources"),
        F.count_distinct("lean_value").alias("lean_spread"),
        F.count_if(F.col("pub_min") >= as_of - 60 * velocity_hours).alias("velocity"),
        F.bool_or(F.col("type") == "agency").alias("agency_flag"),
        F.bool_or(F.col("type") == "official").alias("official_flag"),
        F.max("pub_min").alias("newest_min"),
        F.avg("weight").alias("avg_weight"),
    )


def linear_rank(stories: DataFrame, as_of: int, half_life_hours: float = 12) -> DataFrame:
    """rank_score from the output of `features`; the age is that of the newest article."""
    base = 3.0 * F.col("n_sources") + 2.0 * F.col("lean_spread") + 0.5 * F.col("n_articles") + 1.5 * F.col("velocity") + F.col("agency_flag").cast("int")
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("newest_min")) / 60)
    return stories.withColumn("rank_score", base * F.pow(F.lit(2.0), -age / half_life_hours) * F.col("avg_weight"))


def junk_stories(members: DataFrame, patterns: tuple = JUNK_TITLES) -> DataFrame:
    """(cluster_id, junk): any title of the story matches any pattern."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col("title").rlike(p), F.lit(False))
    return members.groupBy("cluster_id").agg(F.bool_or(hit).alias("junk"))


def latest_posts(posts: DataFrame) -> DataFrame:
    """The latest post of a story; drafts, which have no time, come first."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("pub_min").desc_nulls_first(), F.desc("post_id"))
    return posts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_published(posts: DataFrame) -> DataFrame:
    """The latest published post of a story that has a message."""
    return latest_posts(posts.where("status = 'published' AND message_id IS NOT NULL"))


def repeat_issue(n: Column, at_publish: Column, hours: Column, min_new: int = 3, min_hours: float = 72) -> tuple[Column, Column]:
    """(admit, continuation) for issues: enough new articles, or long enough with any; hours null if never published."""
    new = n - F.coalesce(at_publish, F.lit(0))
    ok = F.when(hours.isNull(), True).otherwise((new >= min_new) | ((hours >= min_hours) & (new > 0)))
    return ok, F.coalesce(hours.isNotNull(), F.lit(False))


def repeat_post(n: Column, at_publish: Column, hours: Column, min_new: int = 3, min_hours: float = 12) -> tuple[Column, Column]:
    """(admit, continuation) for posts: enough new articles and enough hours."""
    new = n - F.coalesce(at_publish, F.lit(0))
    return F.when(hours.isNull(), True).otherwise((new >= min_new) & (hours >= min_hours)), hours.isNotNull()


def candidates(members: DataFrame, posts: DataFrame, as_of: int, min_age_minutes: int = 30) -> DataFrame:
    """Stories that may become posts: admitted, no junk, no draft or skipped last post, repeat rule holds."""
    last = latest_posts(posts).select("cluster_id", F.col("status").alias("last_status"), F.col("pub_min").alias("last_post_min"), "n_at_publish")
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n_articles"))
    pool = spectrum(members, as_of).join(size, "cluster_id").join(junk_stories(members), "cluster_id").join(last, "cluster_id", "left")
    ok, again = repeat_post(F.col("n_articles"), F.col("n_at_publish"), (F.lit(as_of) - F.col("last_post_min")) / 60)
    pool = pool.where("(last_status IS NULL OR last_status = 'published') AND NOT junk AND passes")
    return pool.where((F.col("first_min") <= as_of - min_age_minutes) & ok).withColumn("is_continuation", again)


def close_idle(clusters: DataFrame, as_of: int, idle_hours: int = 36) -> DataFrame:
    return clusters.withColumn("status", F.when(F.col("last_min") < as_of - 60 * idle_hours, "closed").otherwise("open"))


def expire_candidates(members: DataFrame, posts: DataFrame, as_of: int, morning: bool, window_hours: int = 4, review_from_hour: int = 17) -> DataFrame:
    """Stories that had their time, were never posted and are not admitted; outside the morning run those of last evening are spared."""
    today = as_of - as_of % 1440
    s = spectrum(members, as_of).where((F.col("first_min") < as_of - 60 * window_hours) & ~F.col("passes"))
    s = s.join(posts.select("cluster_id").distinct(), "cluster_id", "left_anti")
    if not morning:
        s = s.where(~((F.col("first_min") >= today - 1440 + 60 * review_from_hour) & (F.col("first_min") < today)))
    return s.select("cluster_id", "first_min")


def best_article_per_source(members: DataFrame) -> DataFrame:
    """One article an outlet and story: with a body first, then the newest, then the least id."""
    w = Window.partitionBy("cluster_id", "source_id").orderBy(F.col("body").isNotNull().desc(), F.desc("pub_min"), "id")
    return members.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def newest_per_owner(members: DataFrame) -> DataFrame:
    w = Window.partitionBy("cluster_id", owner()).orderBy(F.desc("pub_min"), "id")
    return members.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def round_robin(rows: DataFrame, group: Column, within: list, order: Column, limit: int) -> DataFrame:
    """Take turns over the groups of a story: `order` of the groups in a turn, `within` of the rows in a group; `pick` from 1."""
    turn = F.row_number().over(Window.partitionBy("cluster_id", group).orderBy(*within))
    picked = rows.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    pick = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_turn", order))
    return picked.withColumn("pick", pick).where(F.col("pick") <= limit).drop("_turn")


def pick_diverse(best: DataFrame, limit: int = 5) -> DataFrame:
    """Turns over leanings by name, for the texts of a summary."""
    return round_robin(best, F.col("lean"), ["source_id"], F.col("lean"), limit)


def pick_issue_links(best: DataFrame, limit: int = 3) -> DataFrame:
    """Turns over leanings from the edges inwards; all outlets in order when they fit."""
    edge = -2 * F.abs("lean_value") + (F.col("lean_value") > 0).cast("int")
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    rows = best.withColumn("_n", n)
    few = rows.where(F.col("_n") <= limit).withColumn("pick", F.row_number().over(Window.partitionBy("cluster_id").orderBy("source_id")))
    many = round_robin(rows.where((F.col("_n") > limit) & F.col("lean_value").isNotNull()), F.col("lean"), ["source_id"], edge, limit)
    return few.unionByName(many).drop("_n")


def pick_post_links(members: DataFrame, limit: int = 5) -> DataFrame:
    """One link an owner, turns over buckets, agencies and official outlets, edges first; `pick` then orders them left to right."""
    rows = newest_per_owner(members)
    key = F.when(F.col("type") == "agency", "agency").when(F.col("type") == "official", "official").otherwise(F.coalesce(bucket(), F.lit("center")))
    place = F.when(F.col("type") == "official", 99).otherwise(F.coalesce("lean_value", F.lit(0)))
    rows = rows.withColumn("_key", key).withColumn("_place", place)
    turns = F.expr("CASE _key WHEN 'left' THEN 1 WHEN 'right' THEN 2 WHEN 'center' THEN 3 WHEN 'agency' THEN 4 ELSE 5 END")
    extreme = F.when(F.col("_key").isin("left", "right"), -F.abs("lean_value")).otherwise(F.col("_place"))
    picked = round_robin(rows, F.col("_key"), [extreme, "_place", "id"], turns, limit) if limit > 0 else rows.withColumn("pick", F.lit(0))
    order = Window.partitionBy("cluster_id").orderBy("_place", "id")
    return picked.withColumn("pick", F.row_number().over(order)).drop("_key", "_place")


def spectrum_edges(members: DataFrame) -> DataFrame:
    """The leftmost and the rightmost outlet of a story."""
    one = best_article_per_source(members).withColumn("_place", F.when(F.col("type") == "official", 99).otherwise(F.coalesce("lean_value", F.lit(0))))
    up = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_place", "source_id"))
    down = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("_place"), F.desc("source_id")))
    return one.withColumn("_u", up).withColumn("_d", down).where("_u = 1 OR _d = 1").select("cluster_id", "source_id", F.when(F.col("_u") == 1, "left").otherwise("right").alias("edge"))


def spectrum_picks(members: DataFrame, limit: int = 2) -> DataFrame:
    """(cluster_id, source_id, pick): outlets left to right; of more than `limit` the two edges, and then from the middle outwards."""
    one = best_article_per_source(members).withColumn("_place", F.when(F.col("type") == "official", 99).otherwise(F.coalesce("lean_value", F.lit(0))))
    line = one.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "source_id"))), lambda x: x["source_id"]).alias("line"))
    first, last, size = F.get("line", F.lit(0)), F.element_at("line", -1), F.size("line")
    start = F.struct(F.slice("line", F.lit(2), F.greatest(size - 2, F.lit(0))).alias("middle"), F.array().cast("array<string>").alias("picked"))

    def step(acc: Column, _: Column) -> Column:
        middle, at = acc["middle"], F.floor(F.size(acc["middle"]) / 2).cast("int")
        rest = F.concat(F.slice(middle, F.lit(1), at), F.slice(middle, at + 2, F.size(middle)))
        return F.struct(rest.alias("middle"), F.concat(acc["picked"], F.array(F.get(middle, at))).alias("picked"))

    more = F.aggregate(F.sequence(F.lit(1), F.lit(limit - 2)), start, step)["picked"] if limit > 2 else F.array().cast("array<string>")
    picks = F.when(size <= limit, F.col("line")).otherwise(F.concat(F.array(first), more, F.array(last)))
    return line.select("cluster_id", F.posexplode(picks).alias("p", "source_id")).select("cluster_id", "source_id", (F.col("p") + 1).alias("pick"))


def time_to_kth_source(members: DataFrame, ks: tuple = (2, 3, 5)) -> DataFrame:
    """Median and ninth decile of the minutes from a story's first article to its k-th outlet."""
    first = members.groupBy("cluster_id", "source_id").agg(F.min("pub_min").alias("m"))
    w = Window.partitionBy("cluster_id").orderBy("m", "source_id")
    k = first.withColumn("k", F.row_number().over(w)).withColumn("wait", F.col("m") - F.min("m").over(Window.partitionBy("cluster_id")))
    out = k.where(F.col("k").isin(*ks)).groupBy("k")
    return out.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY wait)").cast("bigint").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY wait)").cast("bigint").alias("p90"))


def short_news(members: DataFrame, seen: DataFrame, as_of: int, max_lines: int = 12, max_world: int = 4, min_age: float = 6, max_age: float = 30, min_owners: int = 2) -> DataFrame:
    """Two flows: admitted stories of scope world (few), and near misses of some age; none that was shown before.

    `members` may have a `scope`; without one no story is of the world.
    """
    scope = F.max("scope").alias("scope") if "scope" in members.columns else F.max(F.lit(None).cast("string")).alias("scope")
    s = spectrum(members, as_of).join(members.groupBy("cluster_id").agg(scope), "cluster_id").join(seen, "cluster_id", "left_anti")
    age = (F.lit(as_of) - F.col("first_min")) / 60
    s = s.where(age <= max_age)
    top = [F.desc("score"), F.col("cluster_id")]
    world = s.where("passes AND scope = 'world'").orderBy(*top).limit(max_world)
    near = s.where(~F.col("passes") & (F.col("n_political") >= min_owners) & (age >= min_age)).orderBy(*top).limit(max_lines)
    return world.unionByName(near).orderBy(*top).limit(max_lines)
