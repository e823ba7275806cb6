"""Readers of the input tables and their views as sources, chunks and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_count, trimmed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables; columns and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than there are cores, dealt out to all of them.

    Text functions cost far more than moving such an input, whose size is bounded by
    its few splits. Larger inputs are left as they are read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sources(documents: DataFrame) -> DataFrame:
    """``documents`` as ingested sources, with content hash and sizes."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("source_id"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_ref"),
        F.col("source").alias("folder"),
        F.sha2(text, 256).alias("content_hash"),
        token_count(text).alias("token_count"),
        F.octet_length(text).cast("long").alias("file_size"),
    )


def line_chunks(documents: DataFrame) -> DataFrame:
    """Each non-empty line of a document is a chunk: doc_id, ord (dense from 1), text.

    The order is settled inside the row, so no shuffle is needed.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), trimmed), lambda x: x != "")
    chunks = documents.select("doc_id", F.posexplode(lines).alias("pos", "text"))
    return chunks.select("doc_id", (F.col("pos") + 1).cast("long").alias("ord"), "text")


def messages(conversations: DataFrame) -> DataFrame:
    """``conversations`` as a session log: session_id, seq (from 1), role, content."""
    return conversations.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("seq"), "role", F.coalesce("text", F.lit("")).alias("content"))
