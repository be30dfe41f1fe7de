"""From raw documents to packed training sequences; every stage calls an operator of newsloom.llm.

Each stage takes (spark, docs, sf_dir), judges all that its predecessor kept, and, but for the last, returns
the columns of the documents. run() writes every stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontam, langid, near_copies, packing, quality
from newsloom.llm.common import fresh_dir, table

#: A document none of whose languages reaches this share of its words is rejected.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; drops `und` (no text, no letter) and texts that no language leads."""
    out, names = langid.identify(docs, langid.fit(docs))
    return out.where((F.col(names["lang_pred"]) != langid.UND) & (F.col(names["score"]) >= LEAST_SHARE)).select(*_columns(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and its language's or script's bands.

    Null and blank texts go; a null language takes the script's band; rows are judged one by one, so repeated
    rows stay or go together. An empty table stays empty.
    """
    out, names = quality.quality_rules(docs)
    return out.where(F.col(names["kept"])).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: five-word shingle sets of similarity 0.8 or more, linked in chains.

    SimHash trie links come first, every link is verified on whole texts, and the join is completed to an exact
    one. The least doc_id of a group stays; of rows that repeat a doc_id the first by text. Null and blank texts are
    copies of each other. Rows without a doc_id stay.
    """
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of `benchmark`, verbatim or re-parameterised.

    Null texts hold none. Rows that share a doc_id go together; rows without one stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document in sequences of at most 2048 tokens; a null text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenisers and learned models have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
