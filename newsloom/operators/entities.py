"""Names and facts: alias matching, mention search, the fact pool's life cycle and picks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators.dedup import first_of
from newsloom.sources import shared

#: Fixed order of fact kinds.
KIND_ORDER = ["role", "classification", "scale", "legal", "evaluative"]


def kind_rank(c: str = "kind") -> Column:
    return F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col(c))


def match_exact(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, entity_id): equal normalised names; the least entity on a tie."""
    a = aliases.groupBy("alias").agg(F.min("entity_id").alias("entity_id"))
    return surfaces.withColumn("alias", X.entity_key(F.col("surface"))).join(a, "alias").select("surface", "entity_id")


def match_surname(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, entity_id): the last word, of more than three letters, is a word of an alias. Candidates only."""
    tokens = aliases.select("entity_id", F.explode(F.split("alias", " ")).alias("token")).groupBy("token").agg(F.min("entity_id").alias("entity_id"))
    last = F.element_at(F.split(X.entity_key(F.col("surface")), " "), -1)
    return surfaces.withColumn("token", last).where(F.length("token") > 3).join(tokens, "token").select("surface", "entity_id")


def _deletions(c: Column, most: int) -> Column:
    """A word and what is left of it without one (and two) letters."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array_union(F.array(c), one(c))
    return F.array_distinct(F.array_union(out, F.flatten(F.transform(one(c), one)))) if most > 1 else F.array_distinct(out)


def match_fuzzy(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, entity_id, distance): least edit distance of at most 1 (keys under eight letters) or 2, both of five or more.

    Names within two edits share a name with at most two letters deleted from each, so the join on deletions loses none.
    """
    s = surfaces.select("surface", X.entity_key(F.col("surface")).alias("key")).where(F.length("key") >= 5)
    a = aliases.where(F.length("alias") >= 5)
    ds = s.withColumn("d", F.explode(_deletions(F.col("key"), 2)))
    da = a.select("entity_id", "alias", F.explode(_deletions(F.col("alias"), 2)).alias("d"))
    met = ds.join(da, "d").select("surface", "key", "entity_id", "alias").distinct()
    limit = F.when(F.length("key") < 8, 1).otherwise(2)
    met = met.withColumn("distance", F.levenshtein("key", "alias")).where(F.col("distance") <= limit)
    return first_of(met, ["surface"], ["distance", "entity_id", "alias"]).select("surface", "entity_id", "distance")


def mentions(names: DataFrame, texts: DataFrame, top: int = 5) -> DataFrame:
    """(entity_id, id): the newest texts that hold a name as whole words.

    Names meet texts on their rarest word, counted over the texts; only what meets is searched. Texts are normalised once.
    """
    apart = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    t = shared.stored(shared.spread(texts).select("id", "pub_min", apart(X.normalize_title(F.col("text"))).alias("flat")), "flat")
    tokens = t.select("id", F.explode(F.array_distinct(F.split(F.trim("flat"), " "))).alias("token"))
    n = names.select("entity_id", X.entity_key(F.col("name")).alias("key")).where("key <> ''")
    split = n.select("entity_id", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("token"))
    counts = tokens.join(split.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = first_of(split.join(counts, "token"), ["entity_id"], ["n", "token"]).select("entity_id", "key", "token")
    met = tokens.join(rarest, "token").select("entity_id", "key", "id").join(t, "id")
    found = met.where(F.contains("flat", apart(F.col("key"))))
    w = Window.partitionBy("entity_id").orderBy(F.desc("pub_min"), "id")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("entity_id", "id", "rn")


def diverse_sources(rows: DataFrame, top: int = 3) -> DataFrame:
    """Per entity: the newest of every bucket first, then the rest by recency; rows without a bucket are never its first."""
    rank = F.when(F.col("bucket") == "", 2).otherwise(F.least(F.row_number().over(Window.partitionBy("entity_id", "bucket").orderBy(F.desc("pub_min"), "id")), F.lit(2)))
    w = Window.partitionBy("entity_id").orderBy("_first", F.desc("pub_min"), "id")
    return rows.withColumn("_first", rank).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= top).drop("_first")


def live(facts: DataFrame, as_of: int) -> DataFrame:
    return facts.where((F.col("status") == "active") & (F.col("expires_min").isNull() | (F.col("expires_min") > as_of)))


def expire_legal(facts: DataFrame, as_of: int) -> DataFrame:
    gone = (F.col("kind") == "legal") & (F.col("status") == "active") & (F.col("expires_min") <= as_of)
    return facts.withColumn("status", F.when(gone, "stale").otherwise(F.col("status")))


def retire_legal(facts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Legal facts that the last look did not confirm are retired."""
    keep = confirmed.select("fact_id", F.lit(True).alias("_keep")).distinct()
    gone = (F.col("kind") == "legal") & F.col("status").isin("active", "stale") & F.col("_keep").isNull()
    return facts.join(keep, "fact_id", "left").withColumn("status", F.when(gone, "retired").otherwise(F.col("status"))).drop("_keep")


def admit(facts: DataFrame, vocabulary: list[str], as_of: int, legal_days: int = 30) -> DataFrame:
    """Status, expiry and topics of new facts (tier, attribution, names): press opinion waits as a candidate unless it is about the speaker."""
    key = lambda c: X.entity_key(F.col(c))
    about_self = F.contains(key("names"), key("attribution")) | F.contains(key("attribution"), key("names"))
    waits = (F.col("tier") == "press") & F.col("kind").isin("evaluative", "classification") & ~F.coalesce(about_self & (key("attribution") != ""), F.lit(False))
    return (
        facts.withColumn("status", F.when(waits, "candidate").otherwise("active"))
        .withColumn("expires_min", F.when(F.col("kind") == "legal", as_of + 1440 * legal_days))
        .withColumn("topics", F.array_sort(F.array_intersect("topics", F.array(*map(F.lit, vocabulary)))))
    )


def save_unique(known: DataFrame, new: DataFrame) -> DataFrame:
    """New facts whose (entity, lower trimmed text) is not known; what was retired never comes back."""
    key = F.lower(F.trim("fact"))
    fresh = first_of(new.withColumn("_key", key), ["entity_id", "_key"], ["fact_id"])
    return fresh.join(known.select("entity_id", key.alias("_key")).distinct(), ["entity_id", "_key"], "left_anti").drop("_key")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(entity_id, a, b): pairs of different rows (entity_id, key, stems) of an entity whose stems overlap, over the smaller set, by `threshold` or more.

    The smaller set of such a pair shares one of its len - ceil(threshold * len) + 1 rarest stems with the other, so only those
    are looked up among all stems of the sets that are no smaller. A pair is tried once, at the first of them that the other
    holds. `a` is the smaller set; `key` orders sets of equal size.
    """
    stems = sets.select("entity_id", "key", F.explode("stems").alias("stem"))
    counts = stems.groupBy("entity_id", "stem").agg(F.count("*").alias("n"))
    ranked = stems.join(counts, ["entity_id", "stem"]).groupBy("entity_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "stem"))).alias("r"))
    ranked = shared.stored(ranked.select("entity_id", "key", F.col("r.stem").alias("stems")), "stems")  # a fact's few stems a row
    need = F.ceil(F.size("stems") * threshold - 1e-9)
    first = F.slice("stems", F.lit(1), (F.size("stems") - need + 1).cast("int"))
    left = ranked.select("entity_id", F.col("key").alias("a"), F.col("stems").alias("sa"), first.alias("pa")).withColumn("stem", F.explode("pa"))
    right = ranked.select("entity_id", F.col("key").alias("b"), F.col("stems").alias("sb"), F.explode("stems").alias("stem"))
    na, nb = F.size("sa"), F.size("sb")
    met = left.join(right, ["entity_id", "stem"]).where(((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))) & (F.get(F.filter("pa", lambda x: F.array_contains("sb", x)), 0) == F.col("stem")))
    return met.where(F.size(F.array_intersect("sa", "sb")) / na >= threshold).select("entity_id", "a", "b")


def reconcile(facts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(fact_id, outcome) of candidates: held with fewer than two buckets; classified when buckets agree; activated if attributed opinion; else kept.

    Of two agreeing facts the earlier one must name its bucket. Facts of one bucket with the same stems are compared as
    one: of those without a bucket only the least and the largest id matter.
    """
    c = facts.where("status = 'candidate'").withColumn("stems", F.array_sort(X.stems(F.col("fact")))).withColumn("_bucket", F.coalesce("bucket", F.lit("")))
    sides = c.groupBy("entity_id").agg(F.count_distinct(F.nullif("bucket", F.lit(""))).alias("sides"))
    c = shared.stored(c.join(sides, "entity_id").select("fact_id", "entity_id", "kind", "attribution", "sides", "stems", "_bucket"), "candidates")
    keys = ["entity_id", "_bucket", "stems"]
    classes = c.where(F.col("sides") >= 2).where(F.size("stems") > 0).groupBy(*keys).agg(F.min("fact_id").alias("lo"), F.max("fact_id").alias("hi"))
    of = classes.select("entity_id", "stems", F.struct("lo", "hi", F.col("_bucket").alias("bucket")).alias("key"))
    met = similar_sets(of, threshold).where("a.bucket <> b.bucket")
    both = met.select("entity_id", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(met.select("entity_id", F.col("b").alias("x"), F.col("a").alias("y")))
    named, other = F.col("x.bucket") != "", F.col("y.bucket") != ""
    hits = both.groupBy("entity_id", F.col("x.bucket").alias("_bucket"), F.col("x.lo").alias("lo")).agg(
        F.bool_or(named & other).alias("all"), F.max(F.when(named & ~other, F.col("y.hi"))).alias("below"), F.min(F.when(~named & other, F.col("y.lo"))).alias("above")
    )
    marked = c.join(classes.join(hits, ["entity_id", "_bucket", "lo"]).select(*keys, "all", "below", "above"), keys, "left")
    hit = F.coalesce("all", F.lit(False)) | F.coalesce(F.col("fact_id") < F.col("below"), F.lit(False)) | F.coalesce(F.col("fact_id") > F.col("above"), F.lit(False))
    outcome = F.when(F.col("sides") < 2, "held").when(hit, "classified").when((F.col("kind") == "evaluative") & F.col("attribution").isNotNull() & (F.col("attribution") != ""), "activated").otherwise("kept")
    return marked.select("fact_id", "entity_id", outcome.alias("outcome"))


def drop_similar(facts: DataFrame, threshold: float = 0.7, known: DataFrame | None = None) -> DataFrame:
    """Facts (entity_id, fact_id) that repeat neither a known fact nor an earlier kept one of their entity, in order of fact_id.

    The order-first choice in rounds: among facts that conflict, those with no earlier rival left are kept, their later rivals
    go, and so on until no conflict is left. Facts with the same stems stand for each other, so copies make no pairs; a
    fact without stems conflicts with none. A round is two joins on what is still open, whatever an entity holds.
    """
    part = lambda df, new: df.select("entity_id", "fact_id", F.lit(new).alias("new"), F.array_sort(X.stems(F.col("fact"))).alias("stems"))
    rows = part(facts, True) if known is None else part(facts, True).unionByName(part(known, False))
    rows = shared.stored(rows, "facts")
    some = rows.where(F.size("stems") > 0)
    # The first of those with the same stems, known ones before all; false sorts first.
    reps = some.groupBy("entity_id", "stems").agg(F.min(F.struct("new", "fact_id")).alias("key"))
    met = similar_sets(reps, threshold)
    pairs = met.select("entity_id", F.least("a", "b").alias("e"), F.greatest("a", "b").alias("l")).where("l.new")
    open_, gone, end = shared.stored(pairs, "rivals"), [], ["entity_id"]
    while not open_.isEmpty():
        first = open_.select(*end, F.col("e").alias("x")).distinct().join(open_.select(*end, F.col("l").alias("x")).distinct(), [*end, "x"], "left_anti")
        out = shared.stored(open_.join(first.withColumnRenamed("x", "e"), [*end, "e"], "left_semi").select(*end, F.col("l").alias("x")).distinct(), "dropped")
        gone.append(out)
        left = open_.join(out.withColumnRenamed("x", "l"), [*end, "l"], "left_anti").join(out.withColumnRenamed("x", "e"), [*end, "e"], "left_anti")
        open_ = shared.stored(left, "rivals")
    best = reps.select("entity_id", F.col("key").alias("x"))
    for out in gone:
        best = best.join(out, ["entity_id", "x"], "left_anti")
    kept = best.where("x.new").select("entity_id", F.col("x.fact_id").alias("fact_id"))
    return kept.unionByName(rows.where((F.size("stems") == 0) & F.col("new")).select("entity_id", "fact_id"))


def pick_facts(facts: DataFrame, topics: DataFrame, as_of: int, top: int = 2) -> DataFrame:
    """Per (entity, topic): live facts on the topic first, by kind and id; opinion and legal facts only on their topic."""
    f = live(facts, as_of).join(topics, "entity_id").withColumn("on", F.array_contains("topics", F.col("topic")))
    f = f.where(~F.col("kind").isin("evaluative", "legal") | F.col("on"))
    w = Window.partitionBy("entity_id", "topic").orderBy(F.desc("on"), kind_rank(), "fact_id")
    return f.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= top).select("entity_id", "topic", "fact_id", "pick")


def pick_entities(entities: DataFrame, facts: DataFrame, as_of: int, top: int = 2) -> DataFrame:
    """Per post: entities with a pool, not muted; primary first, then least recently explained, then least mentioned."""
    e = entities.where(~F.col("never_explain")).join(live(facts, as_of).select("entity_id").distinct(), "entity_id", "left_semi")
    w = Window.partitionBy("post_id").orderBy((F.col("salience") != "primary"), F.col("last_explained_min").asc_nulls_first(), "mentions", "entity_id")
    return e.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= top)


def entity_stats(entities: DataFrame, aliases: DataFrame, facts: DataFrame, mention_counts: DataFrame, as_of: int) -> DataFrame:
    """Aliases, live facts and mentions of every entity, zeros included."""
    a = aliases.groupBy("entity_id").agg(F.count("*").alias("aliases"))
    f = live(facts, as_of).groupBy("entity_id").agg(F.count("*").alias("live_facts"))
    out = entities.select("entity_id").distinct().join(a, "entity_id", "left").join(f, "entity_id", "left").join(mention_counts, "entity_id", "left")
    return out.select("entity_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("aliases", "live_facts", "mentions")])


def without_pool(entities: DataFrame, facts: DataFrame, mention_counts: DataFrame, top: int = 5) -> DataFrame:
    """The most mentioned entities (entity_id, never_explain) without an active fact."""
    e = entities.where(~F.col("never_explain")).join(facts.where("status = 'active'").select("entity_id").distinct(), "entity_id", "left_anti")
    e = e.join(mention_counts, "entity_id", "left").select("entity_id", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return e.orderBy(F.desc("mentions"), "entity_id").limit(top)


def recheck_queue(facts: DataFrame, mention_counts: DataFrame, top: int = 20) -> DataFrame:
    """Entities to look at again: stale legal facts first, then the oldest pool, then the most mentioned."""
    f = facts.groupBy("entity_id").agg(F.bool_or((F.col("kind") == "legal") & (F.col("status") == "stale")).alias("stale"), F.min(F.when(F.col("status") == "active", F.col("fact_id"))).alias("oldest"))
    j = f.join(mention_counts, "entity_id", "left")
    return j.orderBy(F.desc("stale"), F.col("oldest").asc_nulls_first(), F.desc(F.coalesce("mentions", F.lit(0))), "entity_id").limit(top)


def unresolved(surfaces: DataFrame) -> DataFrame:
    """The queue of unmatched names: count, first and last time, first candidate, spelling as first seen."""
    return surfaces.groupBy(X.entity_key(F.col("surface")).alias("key")).agg(
        F.count("*").alias("n"),
        F.min("at_min").alias("first_min"),
        F.max("at_min").alias("last_min"),
        F.min_by("surface", F.struct("at_min", "id")).alias("spelling"),
        F.min_by("candidate", F.when(F.col("candidate").isNotNull(), F.struct("at_min", "id"))).alias("candidate"),
    )


def notify_queue(queue: DataFrame, handled: DataFrame, least: int = 1, top: int = 8) -> DataFrame:
    return queue.join(handled.select("key"), "key", "left_anti").where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(top)


def foreign_words(contexts: DataFrame, stop: list[str], most_chars: int = 200) -> DataFrame:
    """Words of an assembled text (context) whose stems its facts (array of texts) do not hold; ok if none and short enough."""
    used = F.array_distinct(F.flatten(F.transform("facts", lambda f: F.transform(X.words(f), lambda w: F.substring(w, 1, 5)))))
    own = F.filter("_words", lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$") & ~w.isin(*stop) & ~F.array_contains("_used", F.substring(w, 1, 5)))
    split = contexts.withColumn("_used", used).withColumn("_words", X.words(F.col("context")))
    return split.withColumn("foreign", own).drop("_used", "_words").withColumn("ok", (F.size("foreign") == 0) & (F.length("context") <= most_chars))


def refresh_targets(posts: DataFrame, changed: DataFrame, as_of: int, hours: int = 24, alive: DataFrame | None = None) -> DataFrame:
    """Posts (post_id, entity_ids, pub_min, and entity_context if there is one) to render again because an entity of theirs changed.

    Changed entities that are not among `alive` are deleted ones: they leave the post's ids, in order, and its map of contexts.
    """
    p = posts.where(F.col("pub_min") >= as_of - 60 * hours)
    ids = changed.select("entity_id").distinct()
    gone = ids.withColumn("gone", F.lit(False)) if alive is None else ids.join(alive.select("entity_id", F.lit(False).alias("gone")).distinct(), "entity_id", "left").fillna(True, ["gone"])
    hit = p.select("post_id", F.explode(F.array_distinct("entity_ids")).alias("entity_id")).join(gone, "entity_id").groupBy("post_id")
    hit = hit.agg(F.array_sort(F.collect_set("entity_id")).alias("changed"), F.collect_set(F.when(F.col("gone"), F.col("entity_id"))).alias("_gone"))
    out = [F.filter("entity_ids", lambda e: ~F.array_contains("_gone", e)).alias("entity_ids")]
    if "entity_context" in posts.columns:
        out.append(F.map_filter("entity_context", lambda k, _: F.array_contains("entity_ids", k) & ~F.array_contains("_gone", k)).alias("entity_context"))
    return p.join(hit, "post_id").select("post_id", "changed", *out)


#: Latin letters as Cyrillic ones, groups before single letters.
CYRILLIC = [
    ("ch", "ч"), ("ll", "й"), ("qu", "к"), ("gu", "г"), ("rr", "р"), ("ñ", "нь"), ("á", "а"), ("é", "е"), ("í", "и"), ("ó", "о"), ("ú", "у"), ("ü", "у"), ("à", "а"),
    ("è", "е"), ("ò", "о"), ("ç", "с"), ("j", "х"), ("h", ""), ("z", "с"), ("v", "в"), ("y", "и"), ("x", "кс"), ("w", "в"), ("c", "к"), ("q", "к"), ("a", "а"), ("b", "б"),
    ("d", "д"), ("e", "е"), ("f", "ф"), ("g", "г"), ("i", "и"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"),
]
#: Fixed rules of surnames that Cyrillic already spells: known ones, endings from six letters on, endings from seven letters on.
SLAVIC_KNOWN = ["putin", "stalin", "lenin", "yeltsin", "kalinin"]
SLAVIC_ENDING = "(ov|ev|off|ski|sky|ich|vic|vich|enko)a?$"
SLAVIC_LONG_ENDING = "ina?$"
_CAPITAL = r"\p{Lu}[\p{L}\p{N}_'’-]+"


def to_cyrillic(name: Column) -> Column:
    out = F.lower(name)
    for latin, cyrillic in CYRILLIC:
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    return F.trim(F.regexp_replace(out, "[^а-яё ]", ""))


def is_slavic(surname: Column) -> Column:
    low, n = F.lower(surname), F.length(surname)
    return low.isin(*SLAVIC_KNOWN) | ((n >= 6) & low.rlike(SLAVIC_ENDING)) | ((n >= 7) & low.rlike(SLAVIC_LONG_ENDING))


def latin_names(titles: DataFrame, places: list[str], not_names: list[str]) -> DataFrame:
    """(id, name, at): names of two or three capitalised Latin words in titles (id, title, and `position` if their order counts), without places and Slavic surnames, and their surnames of six letters or more.

    Words of `not_names` that lead a run are no part of the name. `at` sorts names by first appearance, a surname behind its name.
    """
    lead = "|".join(sorted(not_names)) or "(?!)"
    position = F.col("position").cast("long") if "position" in titles.columns else F.lit(0).cast("long")
    run = F.posexplode(F.regexp_extract_all("title", F.lit(rf"({_CAPITAL}(?:\s+(?:(?:de|del|la|y)\s+)?{_CAPITAL}){{0,2}})"), 1)).alias("nth", "run")
    cut = F.regexp_replace(F.regexp_replace("run", r"\s+", " "), rf"^(?:(?:{lead}) ?)+(?= |\p{{Lu}}|$)", "")
    parts = F.split(F.trim("name"), " ")
    last = F.element_at(parts, -1)
    gone = lambda c: F.lower(c).isin(*places) | to_cyrillic(c).isin(*places) if places else F.lit(False)
    rows = titles.select("id", position.alias("position"), "title", run).select("id", "position", "title", "nth", F.trim(cut).alias("name")).where((F.size(parts) >= 2) & F.col("name").rlike("^[^Ѐ-ӿ]+$"))
    rows = rows.where(~gone(F.col("name")) & ~is_slavic(last))
    surname = F.when((F.length(last) >= 6) & ~gone(last), last)
    every = rows.select("id", "position", "title", "nth", F.posexplode(F.array("name", surname)).alias("part", "name")).where("name IS NOT NULL")
    return every.groupBy("id", "name").agg(F.min(F.struct("position", "title", "nth", "part")).alias("at"))


_CYRILLIC_WORD = re.compile("[А-ЯЁ][а-яё]+")
_BLANKS = re.compile(r"\s+")


def _near(a: str, b: str, most: int) -> bool:
    """Are two words within `most` edits?"""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _parts(word: str, most: int) -> list[str]:
    """The word in `most` + 1 parts: each edit touches one at most, so whatever is within `most` edits holds one of them."""
    return [word[len(word) * k // (most + 1) : len(word) * (k + 1) // (most + 1)] for k in range(most + 1)]


def _put(text: str, window: list[str], name: str) -> str:
    """The text with the name wherever the window's words stand, with any blanks between them."""
    out, done, at = [], 0, text.find(window[0])
    while at >= 0:
        end = at + len(window[0])
        for word in window[1:]:
            gap = _BLANKS.match(text, end)
            if gap is None or not text.startswith(word, gap.end()):
                end = None
                break
            end = gap.end() + len(word)
        if end is not None:
            out += [text[done:at], name]
            done = end
        at = text.find(window[0], at + 1 if end is None else end)
    return "".join([*out, text[done:]])


def restored(text: str, names: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """The text after names (Latin, as Cyrillic spells it) are put back one by one, and what was put in for what."""
    made, words = [], None
    for name, target in names:
        if words is None:  # as the last name left the text
            low, words, runs = text.casefold(), _CYRILLIC_WORD.findall(text), {}
        if not target or name.casefold() in low:
            continue
        n, most = len(name.split()), 2 if len(target) >= 8 else 1
        if n not in runs:
            runs[n] = [" ".join(words[i : i + n]).casefold() for i in range(len(words) - n + 1)]
        parts = _parts(target, most)
        for i, run in enumerate(runs[n]):
            if run == target or (abs(len(run) - len(target)) <= most and any(x in run for x in parts) and _near(run, target, most)):
                made.append((name, " ".join(words[i : i + n])))
                text, words = _put(text, words[i : i + n], name), None
                break
    return text, made


def restore_names(posts: DataFrame, names: DataFrame) -> DataFrame:
    """Posts (id, text) with Cyrillic spellings of their stories' Latin names (id, name, at) put back, and `restored` (name, phrase).

    Names are taken in order, each over the text as the ones before left it: one that stands in it in Latin by then is
    passed over. A name replaces the first run of as many capitalised words that spells it, wherever that run occurs; spellings
    may differ by one letter, or two from eight letters on.
    """
    own = names.withColumn("target", to_cyrillic(F.col("name"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "target"))).alias("_n"))

    @F.pandas_udf("text string, restored array<struct<name:string,phrase:string>>")
    def put_back(text: pd.Series, latin: pd.Series, cyrillic: pd.Series) -> pd.DataFrame:
        out = [restored(t, list(zip(a, b))) if t is not None and a is not None else (t, []) for t, a, b in zip(text, latin, cyrillic)]
        return pd.DataFrame({"text": [t for t, _ in out], "restored": [[{"name": n, "phrase": p} for n, p in m] for _, m in out]})

    j = posts.join(own, "id", "left").withColumn("_r", put_back("text", F.col("_n.name"), F.col("_n.target")))
    return j.select(*[F.col("_r.text").alias("text") if c == "text" else F.col(c) for c in posts.columns], F.col("_r.restored").alias("restored"))
