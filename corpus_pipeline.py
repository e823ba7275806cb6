"""The corpus pipeline: language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, minhash, packing, repeats
from marlstone.plans.lineage import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without text or a letter go.

    Prototypes are learned from all labelled documents. A missing label becomes
    the prediction; others stay. If no language was learned, as without labels,
    all documents with a letter stay, and a missing label becomes ``und``.
    """
    names, prototypes = langid.fit(docs)
    if not names:
        return docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", F.lit(langid.UNKNOWN))).select(*COLUMNS)
    known = langid.identify(docs.withColumn("kept_text", F.col("text")), names, prototypes)
    kept = known.filter(F.col("lang_pred") != langid.UNKNOWN).withColumnRenamed("kept_text", "text")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows without an id stay.

    Rows that share an id but not the text are documents of their own (and take
    part under a hash of both); rows that share both are one.
    """
    shared = cut(docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"), F.count("text").alias("n"), F.count(F.lit(1)).alias("m")), "ids")
    shared = shared.filter("doc_id is not null and (lo <> hi or n not in (0, m))").select("doc_id", F.lit(True).alias("shared"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(*COLUMNS, F.col("doc_id").alias("node"))
    if shared.limit(1).count():
        rows = rows.join(shared, "doc_id", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
        rows = cut(rows.select(*COLUMNS, "node"), "nodes")
    kept = minhash.near_duplicates(rows, id_col="node").filter("kept").select(F.col("doc_id").alias("node")).distinct()
    rows = rows.join(kept.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    return rows.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of over 50 words that also stand elsewhere; emptied ones stay, with empty text."""
    left = repeats.remove_passages(docs.select(*COLUMNS))
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None
