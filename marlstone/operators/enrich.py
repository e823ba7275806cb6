"""Entities from a pluggable extractor: guards, attribution, priorities and rollback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds an extractor may give, most bytes of a value, most entities of a source, sources of a batch.
KINDS = ("person", "org", "date", "path", "code", "number", "proper")
MAX_VALUE, MAX_PER_SOURCE, BATCH = 96, 60, 25


def pending(sources: DataFrame, links: DataFrame, limit: int = BATCH) -> DataFrame:
    """Sources that wait for the extractor: those that link to most others first, then longest, newest, by name."""
    linked = links.groupBy(F.col("from_ref").alias("source_ref")).agg(F.countDistinct("to_ref").alias("n_links"))
    waiting = sources.filter(F.coalesce("entity_pass", F.lit("pending")) == "pending").join(linked, "source_ref", "left")
    return waiting.withColumn("n_links", F.coalesce("n_links", F.lit(0))).orderBy(F.desc("n_links"), F.desc("token_count"), F.desc("ingested_at"), "source_ref").limit(limit)


def extract(sources: DataFrame, extractor: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(source_id, pos, kind, value) as the extractor gives them, in one pass over the texts.

    The extractor is any function of a text; a model behind it is loaded once for
    each worker. What it gives is checked by ``guard``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, k, v) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, (k, v) in enumerate(extractor(text or ""))]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["source_id", "pos", "kind", "value"])

    return sources.select("source_id", "text").mapInArrow(run, "source_id long, pos int, kind string, value string")


#: The reply that a model is asked for: kinds are checked by ``guard``, quotes by the guard of links.
REPLY = "entities array<struct<kind: string, value: string>>, links array<struct<target: string, evidence: string>>"


def typed(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (source_id, pos, kind, value), links (source_id, pos, target, quote) and failed sources (source_id) of replies (source_id, reply) in JSON.

    A reply that is null or no JSON object fails as a whole; one without a list has an
    empty one; fields that aren't named are left out. A missing field of an item is
    null, which the guards reject as empty.
    """
    rows = replies.select("source_id", F.from_json("reply", f"{REPLY}, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("r"), "reply")
    failed = F.col("r").isNull() | F.col("r.broken").isNotNull() | ~F.coalesce(F.trim("reply").startswith("{"), F.lit(False))
    rows = rows.select("source_id", failed.alias("failed"), "r.entities", "r.links")
    good = rows.filter("not failed")
    items = lambda c: good.select("source_id", F.posexplode(c).alias("pos", "x"))
    entities = items("entities").select("source_id", "pos", "x.kind", "x.value")
    links = items("links").select("source_id", "pos", "x.target", F.col("x.evidence").alias("quote"))
    return entities, links, rows.filter("failed").select("source_id")


def reject_reason(text: Column, kind: Column, value: Column) -> Column:
    """Why an extracted entity can't be trusted; null if it can."""
    v = F.trim(value)
    return (
        F.when(F.coalesce(v, F.lit("")) == "", "empty")
        .when(F.octet_length(v) > MAX_VALUE, "too long")
        .when(~F.coalesce(F.lower(kind).isin(*KINDS), F.lit(False)), "unknown kind")
        .when(~F.contains(F.lower(text), F.lower(v)), "not in the text")
    )


def guard(extracted: DataFrame, sources: DataFrame) -> DataFrame:
    """Extracted rows with ``reject_reason``: also repeats and those beyond the limit of a source, in order."""
    rows = extracted.join(sources.select("source_id", "text"), "source_id")
    rows = rows.withColumn("value_norm", F.lower(F.trim("value"))).withColumn("kind_norm", F.lower("kind")).withColumn("reject_reason", reject_reason(F.col("text"), F.col("kind"), F.col("value"))).drop("text")
    good = F.col("reject_reason").isNull()
    again = F.row_number().over(Window.partitionBy("source_id", "reject_reason", "kind_norm", "value_norm").orderBy("pos"))
    rows = rows.withColumn("reject_reason", F.when(good & (again > 1), "repeated").otherwise(F.col("reject_reason")))
    place = F.row_number().over(Window.partitionBy("source_id", "reject_reason").orderBy("pos"))
    return rows.withColumn("reject_reason", F.when(good & (place > MAX_PER_SOURCE), "over the limit").otherwise(F.col("reject_reason")))


def attribute(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind, value, count): accepted entities of a source at the chunks that hold them."""
    e = entities.filter("reject_reason is null").select("source_id", F.col("kind_norm").alias("kind"), F.col("value_norm").alias("value"))
    low = F.lower("text")
    hits = chunks.join(e, "source_id").filter(F.contains(low, F.col("value")))
    # Occurrences are counted without patterns: what replacing them takes away.
    times = (F.length(low) - F.length(F.replace(low, F.col("value"), F.lit("")))) / F.length("value")
    return hits.select("chunk_id", "kind", "value", times.cast("long").alias("count"), F.lit("llm").alias("extractor"))


def rollback(chunk_entities: DataFrame, extractor: str) -> DataFrame:
    """Links of all but one extractor."""
    return chunk_entities.filter(F.col("extractor") != extractor)


def rates(guarded: DataFrame) -> DataFrame:
    """How much of what was extracted was rejected, and for what."""
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(1)))
    return guarded.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / total, 6).alias("share"))
