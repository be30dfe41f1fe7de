"""The registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontam, langid, packing, phrases, positive_unlabelled, quality, quotes, simhash, simplex_centroids, suffix_tree, token_counts, token_shards, warc
from newsloom.llm.common import fresh_dir, stored, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, names = quality.quality_rules(docs)
    return out.select("doc_id", *(F.col(n).alias(f) for f, n in names.items()))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    manifest = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no quotes of their own, so Spark first writes them as mail threads do."""
    out = quotes.link(quotes.as_mail(table(spark, sf_dir, "conversations")))
    digest = F.sha2("body", 256).alias("body_sha256")
    return out.select("conv_id", "turn", "role", "parent_turn", "thread_turn", "depth", "quoted", "linked", F.length("body").alias("body_chars"), digest)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a sequence: where it stands, what it holds, and whether the read-back shard has it."""
    folder = fresh_dir(spark, "tokens")
    index = token_shards.write(table(spark, sf_dir, "documents"), folder)
    seen = token_shards.read(spark, folder).select("slot", F.col("crc32").alias("read_crc32"))
    # Spark takes the read-back for as small as the manifest it comes from; both sides grow with the corpus.
    out = index.hint("merge").join(seen, "slot", "left")
    return out.select("slot", "shard", "position", "doc_ids", "starts", "lengths", "crc32", F.coalesce(F.col("crc32") == F.col("read_crc32"), F.lit(False)).alias("intact"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, names = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", fold.alias("held_out"), *(F.col(n).alias(f) for f, n in names.items()))


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are planted and stored; the documents that scrubbing edits then meet theirs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = stored(token_counts.plant(docs), "trees")
    edited, edits = token_counts.with_scrub_edits(docs)
    updates = token_counts.apply_edits(edited.where(F.size(edits) > 0), trees, edits=edits)
    return token_counts.counts_after(trees, updates)


def op9_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_simplex_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, names = positive_unlabelled.scored(docs, positive_unlabelled.fit(docs, table(spark, sf_dir, "labels")))
    fold = positive_unlabelled.fold_of(F.col("doc_id")) == 0
    return out.select("doc_id", fold.alias("held_out"), *(F.col(n).alias(f) for f, n in names.items()))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_quality_rules,
        op3_warc_round_trip,
        op4_quotation_linking,
        op5_packing,
        op6_token_shards,
        op7_language_id,
        op8_edit_aware_counts,
        op9_suffix_tree_score,
        op10_benchmark_decontamination,
        op11_simplex_centroids,
        op12_positive_unlabelled,
        op13_phrase_collocations,
    )
}
ORACLES = {
    "op10_benchmark_decontamination": decontam.ORACLE_SQL,
    "op11_simplex_centroids": simplex_centroids.oracle_sql(),
    "op13_phrase_collocations": phrases.ORACLE_SQL,
}
