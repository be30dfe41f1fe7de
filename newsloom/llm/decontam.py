"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers (in digits or words), names (capitalised words, wherever they stand) and units
after numbers turn into typed placeholders, all else is lower-cased words. Windows of `width` template words
are hashed in the scan's own stage and met with the benchmark's window hashes. Every meeting keeps the
words that stood in its slots. A document's passage (the same shift between document and item) counts if
a window without slots met, or if its slots fit one to one: a value of the item always stands for the
same value in the document and the other way round. So re-parameterised questions are caught, while
chance meetings of templates whose slots contradict each other are not. Every window also meets its own
raw words, so a verbatim copy counts however few of its words are plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import by_ids, cut

#: Fixed list of units that follow a number.
UNITS = "km|kg|cm|mm|mg|ml|m|g|l|h|s|min|hours|hour|minutes|minute|seconds|days|day|weeks|months|years|year|euros|euro|dollars|dollar|percent|miles|meters|metres|litres|liters|pounds"
#: Fixed list of number words.
NUMBERS = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
    "|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
)
NUMBER, UNIT, NAME = "<n>", "<u>", "<p>"
_POINT = r"([0-9])[.,]([0-9])"
_GAP = r"[^\p{L}\p{N}\x02]+"


def flat(text: Column) -> Column:
    """Words with single spaces; decimal points are marked by \\x02."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\x02", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(clean, _POINT, "$1\x02$2"), _GAP, " "))


def template(flat: Column) -> Column:
    x = F.regexp_replace(flat, r"[0-9][0-9\x02]*", NUMBER)
    for _ in range(2):  # neighbours share a space, so every other one waits for the second time
        x = F.regexp_replace(x, rf"(^| )(?i:{NUMBERS})( |$)", rf"$1{NUMBER}$2")
    x = F.regexp_replace(x, rf"{NUMBER} ({UNITS})( |$)", rf"{NUMBER} {UNIT}$2")
    x = F.regexp_replace(x, r"(^| )\p{Lu}\p{Ll}+", rf"$1{NAME}")
    return F.lower(x)


def _windows(df: DataFrame, key: str, text: str, width: int, widths: list[int]) -> DataFrame:
    """(key, pos, wide, whole, hash, raw, w0, w1, ...) of each window, once by the hash of its template and once
    (`whole`) by that of its raw words; `widths` are the window sizes asked for, `raw` the words of the whole text."""
    words = df.select(F.col(key).alias("key"), flat(F.col(text)).alias("flat"))
    words = words.select("key", F.split(template(F.col("flat")), " ").alias("t"), F.split("flat", " ").alias("raw"))
    zipped = F.arrays_zip(*[(F.col("t") if k == 0 else F.slice("t", k + 1, F.greatest(F.size("t") - k, F.lit(0)))).alias(f"w{k}") for k in range(width)])
    columns = [f"w{k}" for k in range(width)]
    rows = words.select("key", "raw", F.posexplode(zipped).alias("pos", "w")).select("key", "raw", "pos", *[F.col("w")[c].alias(c) for c in columns])
    pairs = []
    for n in widths:
        raw = F.xxhash64(F.lit(-n), F.slice("raw", F.col("pos") + 1, n))
        for whole, value in ((False, F.xxhash64(F.lit(n), *columns[:n])), (True, raw)):
            pairs.append(F.struct(F.lit(n).alias("wide"), F.lit(whole).alias("whole"), F.when(F.col(f"w{n - 1}").isNotNull(), value).alias("hash")))
    rows = rows.select("key", "raw", "pos", *columns, F.explode(F.array(*pairs)).alias("x")).where("x.hash IS NOT NULL")
    return rows.select("key", "pos", "x.wide", "x.whole", "x.hash", "raw", *columns)


def _spelled(windows: DataFrame, width: int, mark: str) -> DataFrame:
    """`windows` with the raw and template words of each window alone; names begin with `mark`."""
    words = F.slice("raw", F.col("pos") + 1, F.col("wide"))
    kinds = F.slice(F.array(*[f"w{k}" for k in range(width)]), F.lit(1), F.col("wide"))
    return windows.select("hash", *(F.col(c).alias(f"{mark}_{c}") for c in ("key", "pos", "wide", "whole")), words.alias(f"{mark}_words"), kinds.alias(f"{mark}_template"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 8,
    least_words: int = 4,
    broadcast_windows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_windows): windows of an item, distinct by place, that a document holds.

    An item of fewer than `width` words is one window; one of fewer than `least_words` never counts. A template
    needs as many plain words as half its width, so bare placeholders match nothing; raw words match as they
    are. Null or empty texts have no windows. Repeated document rows count once, so do repeated items of
    one id. At most `broadcast_windows` distinct hashes (16 bytes each, so 16 MB, and twice that as a table of Spark)
    are broadcast, to drop the windows that meet none before any shuffle; with more, the windows are shuffled by hash.
    """
    sized = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL").distinct()
    sized = sized.withColumn("n", F.least(F.lit(width), F.size(F.split(flat(F.col("text")), " "))))
    sized = sized.where(F.col("n") >= least_words)
    widths = sorted(r[0] for r in sized.select("n").distinct().collect()) or [width]  # at most `width` values
    b = _windows(sized, "item_id", "text", width, widths).join(sized.select(F.col("item_id").alias("key"), "n").distinct(), "key")
    plain = sum(F.when(F.lit(k) < F.col("wide"), (~F.col(f"w{k}").contains("<")).cast("int")).otherwise(0) for k in range(width))
    b = b.where((F.col("wide") == F.col("n")) & (F.col("whole") | (2 * plain >= F.col("wide"))))
    b = cut(_spelled(b, width, "b"))
    d = _windows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", width, widths)
    hashes = cut(b.select("hash").distinct())
    if hashes.count() <= broadcast_windows:
        d = d.join(F.broadcast(hashes), "hash", "left_semi")
    same = F.when(F.col("b_whole"), F.col("b_words") == F.col("d_words")).otherwise(F.col("b_template") == F.col("d_template"))
    met = _spelled(d, width, "d").join(b, "hash").where((F.col("b_wide") == F.col("d_wide")) & (F.col("b_whole") == F.col("d_whole")) & same)
    slots = F.filter(F.arrays_zip(F.col("b_template").alias("kind"), F.col("b_words").alias("b"), F.col("d_words").alias("d")), lambda s: s["kind"].contains("<") & ~F.col("b_whole"))
    met = met.select(F.col("d_key").alias("doc_id"), F.col("b_key").alias("item_id"), F.col("b_pos").alias("item_pos"), (F.col("d_pos") - F.col("b_pos")).alias("shift"), slots.alias("slots"))
    met = cut(met)  # few rows, used twice
    one = met.select("doc_id", "item_id", "shift", "item_pos", F.explode_outer("slots").alias("s"))
    judged = one.groupBy("doc_id", "item_id", "shift").agg(
        F.bool_or(F.col("s").isNull()).alias("exact"),
        F.count_distinct("s.kind", "s.b").alias("n_b"),
        F.count_distinct("s.kind", "s.d").alias("n_d"),
        F.count_distinct("s.kind", "s.b", "s.d").alias("n_pairs"),
    )
    fits = judged.where(F.col("exact") | ((F.col("n_b") == F.col("n_pairs")) & (F.col("n_d") == F.col("n_pairs"))))
    places = met.select("doc_id", "item_id", "shift", "item_pos").distinct()
    return places.join(fits.select("doc_id", "item_id", "shift"), ["doc_id", "item_id", "shift"]).groupBy("doc_id", "item_id").agg(
        F.count_distinct("item_pos").alias("n_windows")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage. Rows without a doc_id stay."""
    found = contaminated(docs.where(F.col(doc_id).isNotNull()), benchmark, doc_id, text, **options)
    return by_ids(docs, doc_id, found.select("doc_id"), "left_anti")


#: The same result in DuckDB SQL, for the default parameters and integer ids.
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), flat AS (
  SELECT side, id, trim(regexp_replace(regexp_replace(translate(text, chr(2), ' '),
    '([0-9])[.,]([0-9])', '\1' || chr(2) || '\2', 'g'),
    '[^\p{{L}}\p{{N}}\x02]+', ' ', 'g'), ' ') AS f FROM texts
), numbers AS (
  SELECT side, id, f, regexp_replace(regexp_replace(regexp_replace(f, '[0-9][0-9\x02]*', '<n>', 'g'),
    '(^| )(?i:{NUMBERS})( |$)', '\1<n>\2', 'g'), '(^| )(?i:{NUMBERS})( |$)', '\1<n>\2', 'g') AS x FROM flat
), words AS (
  SELECT side, id, string_split(f, ' ') AS raw,
    string_split(lower(regexp_replace(regexp_replace(x, '<n> ({UNITS})( |$)', '<n> <u>\2', 'g'), '(^| )\p{{Lu}}\p{{Ll}}+', '\1<p>', 'g')), ' ') AS t FROM numbers
), sized AS (
  SELECT *, least(8, len(t)) AS n FROM words
), wide AS (
  SELECT side, id, raw, t, n AS wide FROM sized WHERE side = 1 AND n >= 4
  UNION ALL SELECT s.side, s.id, s.raw, s.t, w.wide FROM sized s, (SELECT DISTINCT n AS wide FROM sized WHERE side = 1 AND n >= 4) w WHERE side = 0
), windows AS (
  SELECT side, id, wide, w.pos AS pos, w.t AS t, w.raw AS raw FROM (
    SELECT side, id, wide, unnest([{{'pos': i, 't': t[i + 1 : i + wide], 'raw': raw[i + 1 : i + wide]}} FOR i IN range(len(t) - wide + 1)]) AS w FROM wide WHERE len(t) >= wide)
), met AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.pos AS item_pos, d.pos - b.pos AS shift, b.wide, b.t AS kind, b.raw AS b, d.raw AS d
  FROM windows d JOIN windows b ON d.side = 0 AND b.side = 1 AND d.wide = b.wide AND d.t = b.t
  WHERE 2 * len([x FOR x IN b.t IF NOT contains(x, '<')]) >= b.wide
), verbatim AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.pos AS item_pos, d.pos - b.pos AS shift
  FROM windows d JOIN windows b ON d.side = 0 AND b.side = 1 AND d.wide = b.wide AND d.raw = b.raw
), exact AS (
  SELECT DISTINCT doc_id, item_id, shift FROM met WHERE len([x FOR x IN kind IF contains(x, '<')]) = 0
  UNION SELECT doc_id, item_id, shift FROM verbatim
), slots AS (
  SELECT doc_id, item_id, shift, kind[i] AS kind, b[i] AS b, d[i] AS d
  FROM (SELECT *, unnest(range(1, wide + 1)) AS i FROM met) WHERE contains(kind[i], '<')
), fits AS (
  SELECT doc_id, item_id, shift FROM slots GROUP BY ALL
  HAVING count(DISTINCT (kind, b)) = count(DISTINCT (kind, b, d)) AND count(DISTINCT (kind, d)) = count(DISTINCT (kind, b, d))
  UNION SELECT * FROM exact
), places AS (
  SELECT doc_id, item_id, shift, item_pos FROM met UNION SELECT doc_id, item_id, shift, item_pos FROM verbatim
)
SELECT doc_id, item_id, count(DISTINCT item_pos) AS n_windows FROM places JOIN fits USING (doc_id, item_id, shift) GROUP BY ALL
"""
