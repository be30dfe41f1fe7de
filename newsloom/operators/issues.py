"""Issues: selection, spacing of topics, packing into messages, token-budget batches and run admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import stories as S


def select_issue(stories: DataFrame, last: DataFrame, as_of: int, least_sources: int = 3, most: int = 7, least: int = 4) -> DataFrame:
    """The best-ranked stories (cluster_id, n_sources, n_articles, rank_score) that the repeat rule admits; no row when too few remain."""
    j = stories.join(last.select("cluster_id", F.col("pub_min").alias("_last"), "n_at_publish"), "cluster_id", "left")
    ok, again = S.repeat_issue(F.col("n_articles"), F.col("n_at_publish"), (as_of - F.col("_last")) / 60)
    j = j.withColumn("is_continuation", again).where((F.col("n_sources") >= least_sources) & ok)
    top = j.orderBy(F.desc("rank_score"), "cluster_id").limit(most)
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc("rank_score"), "cluster_id")  # at most `most` rows
    out = top.withColumn("position", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return out.where(F.col("_n") >= least).select("position", "cluster_id", "n_sources", "n_articles", "is_continuation", "rank_score")


def space_topics(items: DataFrame, most: int = 3) -> DataFrame:
    """Items (issue, position, topic) with a new position: after `most` of one topic in a row others wait and go to the end, in order.

    One pass in order marks what waits, with the last topic and the length of its run as its whole state; a second sort places it.
    """
    kinds = dict(items.dtypes)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, run = None, None, 0
        for pdf in batches:
            later = []
            for issue, topic in zip(pdf.issue, pdf.topic):
                if issue != now:
                    now, last, run = issue, None, 0
                same = run > 0 and topic == last
                wait = same and run >= most
                later.append(wait)
                if not wait:
                    last, run = topic, run + 1 if same else 1
            yield pdf.assign(later=later)

    rows = items.select("issue", "position", "topic").repartition("issue").sortWithinPartitions("issue", "position")
    marked = rows.mapInPandas(mark, f"issue {kinds['issue']}, position {kinds['position']}, topic {kinds['topic']}, later boolean")
    place = F.row_number().over(Window.partitionBy("issue").orderBy("later", "position"))
    return marked.select("issue", "position", "topic", place.alias("new_position"))


def pack_messages(blocks: DataFrame, limit: int = 4096, separator: int = 2, most: int | None = None) -> DataFrame:
    """Blocks (issue, position, length) with the number of the message that holds them: greedy in order, a longer block stands alone.

    With `most`, what would need a later message is left out.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, message, used = None, 0, 0
        for pdf in batches:
            out = []
            for issue, position, length in zip(pdf.issue, pdf.position, pdf.length):
                if issue != now:
                    now, message, used = issue, 1, 0
                if used and used + separator + length > limit:
                    message, used = message + 1, 0
                used += length + (separator if used else 0)
                out.append((issue, position, length, message))
            yield pd.DataFrame(out, columns=["issue", "position", "length", "message"])

    kind = dict(blocks.dtypes)["issue"]
    rows = blocks.select("issue", "position", "length").repartition("issue").sortWithinPartitions("issue", "position")
    out = rows.mapInPandas(fold, f"issue {kind}, position long, length long, message long")
    return out if most is None else out.where(F.col("message") <= most)


def token_batches(texts: DataFrame, shards: int = 16, most_items: int = 256, most_tokens: int = 60_000, chars_per_token: float = 3.2) -> DataFrame:
    """(id, tokens, shard, batch): greedy batches within hash shards, in order of id, by item and token limits."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / chars_per_token).cast("long") + 1)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, items, used = None, 0, 0, 0
        for pdf in batches:
            out = []
            for i, n, shard in zip(pdf.id, pdf.tokens, pdf.shard):
                if shard != now:
                    now, batch, items, used = shard, 0, 0, 0
                if items >= most_items or (items and used + n > most_tokens):
                    batch, items, used = batch + 1, 0, 0
                items, used = items + 1, used + n
                out.append((i, n, shard, batch))
            yield pd.DataFrame(out, columns=["id", "tokens", "shard", "batch"])

    rows = texts.select("id", tokens.alias("tokens"), F.pmod("id", F.lit(shards)).cast("long").alias("shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", "id").mapInPandas(fold, "id long, tokens long, shard long, batch long")


def admit_run(candidates: DataFrame, topics: DataFrame, state: DataFrame, threshold: DataFrame, per_run: int = 2, gap: int = 20, loud_sources: int = 5) -> DataFrame:
    """The posts of a run: best candidates (cluster_id, topic, score, n_sources) whose topic may go on, as many as there is room, some loud.

    `state` is the one row of `quota`, `threshold` that of `score_percentile`.
    """
    c = candidates.join(topics.where("NOT ok").select("topic"), "topic", "left_anti").orderBy(F.desc("score"), "cluster_id").limit(per_run)
    j = c.crossJoin(state.select("room", "loud_left", "minutes_since")).crossJoin(threshold.select("threshold"))  # two single rows
    rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "cluster_id"))  # at most `per_run` rows
    j = j.where(F.coalesce(F.col("minutes_since") >= gap, F.lit(True))).withColumn("rn", rn).where(F.col("rn") <= F.col("room"))
    wants = F.when(F.col("threshold").isNotNull(), F.col("score") >= F.col("threshold")).otherwise(F.col("n_sources") >= loud_sources)
    nth = F.sum(wants.cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("rn"))
    return j.withColumn("loud", wants & (nth <= F.col("loud_left"))).select("rn", "cluster_id", "topic", "score", "loud")


def write_issue(items: DataFrame, issue_id: int, folder: str) -> None:
    """The header row and the items, positions from 1, with their links; two tables under a folder, a partition an issue: writing an issue again replaces it."""
    n = Window.partitionBy(F.lit(1)).orderBy("position")  # a handful of items
    rows = items.withColumn("position", F.row_number().over(n))
    rows.agg(F.count("*").alias("n_items")).write.mode("overwrite").parquet(f"{folder}/issues/issue_id={issue_id}")
    rows.write.mode("overwrite").parquet(f"{folder}/issue_items/issue_id={issue_id}")
