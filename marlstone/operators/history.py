"""Turns and artifacts that exist already, brought into the memory store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions.text import trimmed
from ..plans.lineage import cut
from . import build, conversation, ingest, store

#: Columns of a source that is about to be stored.
SOURCE = ("source_type", "source_ref", "session_id", "title", "content_hash")


def turn_sources(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Accepted turns of known sessions as sources with ``text`` and what leads to them; the hash covers the reasoning too."""
    pairs = conversation.turn_pairs(messages).join(sessions.select("session_id", F.coalesce("title", F.lit("")).alias("title")), "session_id")
    hashed = F.sha2(F.concat("turn_text", F.lit("\0"), F.coalesce("cot", F.lit(""))), 256)
    return pairs.withColumn("source_type", F.lit("conversation")).withColumn("source_ref", F.col("ref")).withColumn("content_hash", hashed)


def artifact_sources(artifacts: DataFrame) -> DataFrame:
    """Artifacts with content as sources."""
    content = trimmed(F.coalesce("content", F.lit("")))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled artifact"))
    rows = artifacts.withColumn("content", content).filter("content <> ''")
    return rows.withColumn("source_type", F.lit("artifact")).withColumn("source_ref", F.col("artifact_id")).withColumn("title", title).withColumn("content_hash", F.sha2("content", 256))


def with_action(found: DataFrame, sources: DataFrame) -> DataFrame:
    """``found`` sources with ``action``: added, changed or, if the stored hash is the same, unchanged."""
    known = sources.select("source_type", "source_ref", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    action = F.when(F.col("was").isNull(), "added").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    return found.join(known, ["source_type", "source_ref"], "left").withColumn("action", action).drop("was", "old_hash")


def ingest_history(known: store.Store, embedder: embedding.Embedder | None = None) -> tuple[store.Store, DataFrame]:
    """The store after all turns of its ``sessions`` and all its ``artifacts`` were read, and (source_type, action, n).

    What is stored unchanged is passed over, so that a second run changes nothing; turns
    that aren't accepted count under the reason. New chunks get vectors, and edges are
    built whole, as history may touch every source. Sources without a chunk are left out.
    """
    turns = with_action(turn_sources(known["sessions"], known["messages"]), known["sources"])
    turns = cut(turns.select(*SOURCE, "action", "ref", "turn_text", "prev_gist", "cot", "start_seq"), "turns")
    made = cut(with_action(artifact_sources(known["artifacts"]), known["sources"]).select(*SOURCE, "action", "artifact_id", "content_type", "content"), "artifacts")
    fresh = F.col("action") != "unchanged"
    said = ingest.turn_chunks(turns.filter(fresh), F.col("title")).withColumnRenamed("ref", "source_ref").withColumn("source_type", F.lit("conversation"))
    wrote = ingest.artifact_chunks(made.filter(fresh)).withColumnRenamed("artifact_id", "source_ref").withColumn("source_type", F.lit("artifact"))
    wrote = wrote.withColumn("terms", ingest.terms(F.col("chunk"))).withColumn("entities", ingest.entity_array(F.col("chunk")))
    columns = ["source_type", "source_ref", "ord", F.col("chunk").alias("text"), "heading_path", "token_count", "terms", "entities"]
    chunks = cut(said.select(*columns).unionByName(wrote.select(*columns)), "chunks")
    heads = turns.filter(fresh).select(*SOURCE).unionByName(made.filter(fresh).select(*SOURCE)).join(chunks.select("source_type", "source_ref").distinct(), ["source_type", "source_ref"], "left_semi")
    nothing = [c for c in known["sources"].columns if c not in (*SOURCE, "source_id", "token_count")]
    heads = heads.withColumn("token_count", F.lit(0).cast("long")).select("*", *[F.lit(None).cast(known["sources"].schema[c].dataType).alias(c) for c in nothing])
    next_ = store.replace_sources(known, heads, chunks.drop("terms", "entities"))
    next_["sources"] = cut(next_["sources"], "sources")
    next_["chunks"] = cut(ingest.backfill(next_["chunks"], "chunk_id", "text", embedder=embedder or embedding.HashEmbedder()), "chunks")
    placed = next_["chunks"].join(next_["sources"].select("source_id", "source_type", "source_ref"), "source_id").select("chunk_id", "source_type", "source_ref", "ord")
    found = cut(chunks.select("source_type", "source_ref", "ord", "terms", "entities").join(placed, ["source_type", "source_ref", "ord"]).select("chunk_id", "terms", "entities"), "found")
    postings = found.select("chunk_id", F.explode("terms").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    named = found.select("chunk_id", F.explode("entities").alias("e")).groupBy("chunk_id", "e.kind", "e.value").agg(F.count(F.lit(1)).alias("count")).withColumn("extractor", F.lit("heuristic"))
    next_["terms"] = cut(next_["terms"].unionByName(postings), "terms")
    next_["entities"] = cut(next_["entities"].unionByName(named), "entities")
    links = next_["links"] if "pos" in next_["links"].columns else next_["links"].withColumn("pos", F.xxhash64("raw"))
    next_["edges"] = cut(build.build_edges(next_["sources"], next_["chunks"], links, next_["entities"]), "edges")
    skipped = conversation.turns(known["messages"]).filter("skip_reason is not null").join(known["sessions"].select("session_id"), "session_id", "left_semi")
    counted = turns.select("source_type", "action").unionByName(made.select("source_type", "action")).unionByName(skipped.select(F.lit("conversation").alias("source_type"), F.col("skip_reason").alias("action")))
    return next_, counted.groupBy("source_type", "action").agg(F.count(F.lit(1)).alias("n"))
