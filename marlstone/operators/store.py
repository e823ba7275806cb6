"""The memory store as a set of snapshots: sources, chunks, postings, entities, links, edges, sessions.

A store is a dictionary of DataFrames.  Every operator returns the next one and
leaves tables that it doesn't touch as they are; the caller writes what changed
beside the old snapshot and switches.

* ``sources``: source_id, source_type, source_ref, session_id, title, content_hash, token_count, entity_pass
* ``chunks``: chunk_id, source_id, ord, text, token_count; ``embedding`` if there are vectors
* ``terms``: chunk_id, term, tf; ``entities``: chunk_id, kind, value, count, extractor
* ``links``: from_ref, to_ref, heading, raw, embed, kind; ``edges``: src, dst, kind, weight
* ``sessions``: session_id, title, created_at, pinned; and rows of a session in ``messages``, ``artifacts``,
  ``plan_steps``, ``disabled_tools``, ``options``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Store = dict[str, DataFrame]

#: States of the extraction pass, defaults of sessions and artifacts, source types that belong to a session.
PENDING, DONE, FAILED = "pending", "done", "failed"
NEW_SESSION, NEW_ARTIFACT, PLAIN = "New Chat", "Untitled", "text"
OF_SESSIONS = ("conversation", "artifact")
SESSION_TABLES = ("artifacts", "messages", "plan_steps", "disabled_tools", "options", "sessions")
BY_CHUNK = ("terms", "entities")


def _filled(c: str, value: object) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))


def drop_sources(store: Store, gone: DataFrame) -> Store:
    """Without the sources in ``gone`` (source_id) and all that hangs on their chunks, edges at either end included."""
    gone = gone.select("source_id").distinct()
    out = dict(store)
    for name in ("sources", "chunks"):
        out[name] = store[name].join(gone, "source_id", "left_anti")
    lost = store["chunks"].join(gone, "source_id", "left_semi").select("chunk_id")
    for name in BY_CHUNK:
        if name in store:
            out[name] = store[name].join(lost, "chunk_id", "left_anti")
    if "edges" in store:
        for end in ("src", "dst"):
            out["edges"] = out["edges"].join(lost.select(F.col("chunk_id").alias(end)), end, "left_anti")
        out["edges"] = out["edges"].select(*store["edges"].columns)
    return out


def replace_sources(store: Store, sources: DataFrame, chunks: DataFrame) -> Store:
    """Sources (source_type, source_ref, ...) with their chunks (source_type, source_ref, text, token_count, ...) take the places of what is stored for them.

    A source keeps the id that its reference has, or gets one from its reference.
    ``ord`` counts from 1 where it is given as null or 0; tokens that aren't given
    are the sum of the chunks'; the extraction pass starts anew.  Postings, entities
    and edges of the old chunks go; those of the new ones are the caller's to add.
    Rows without type or reference are refused.
    """
    keys = ["source_type", "source_ref"]
    known = store["sources"].select(*keys, F.col("source_id").alias("old_id"))
    named = sources.filter(" and ".join(f"coalesce({k}, '') <> ''" for k in keys)).drop("source_id").join(known, keys, "left")
    named = named.withColumn("source_id", F.coalesce("old_id", F.sha2(F.concat_ws("\0", *keys), 256)))
    sums = chunks.groupBy(*keys).agg(F.sum("token_count").alias("sum_tokens"))
    fresh = named.join(sums, keys, "left").withColumn("token_count", F.coalesce(F.nullif("token_count", F.lit(0)), "sum_tokens", F.lit(0)).cast("long")).withColumn("entity_pass", _filled("entity_pass", PENDING))
    out = drop_sources(store, named.filter("old_id is not null").select(F.col("old_id").alias("source_id")))
    out["sources"] = out["sources"].unionByName(fresh.select(*store["sources"].columns))
    placed = chunks.join(named.select(*keys, "source_id"), keys)
    made = placed.withColumn("chunk_id", F.sha2(F.concat_ws("\0", "source_id", F.col("ord").cast("string")), 256))
    out["chunks"] = out["chunks"].unionByName(made.select(*[c for c in store["chunks"].columns if c in made.columns]), allowMissingColumns=True)
    return out


def replace_links(links: DataFrame, refs: DataFrame, new: DataFrame, kind: str = "link") -> DataFrame:
    """Links of one kind from each of ``refs`` (from_ref) become those in ``new``: repeats once, those without a target left out."""
    stays = links.join(refs.select("from_ref").distinct().withColumn("kind", F.lit(kind)), ["from_ref", "kind"], "left_anti")
    comes = new.filter(F.coalesce("to_ref", F.lit("")) != "").join(refs.select("from_ref").distinct(), "from_ref", "left_semi").withColumn("kind", F.lit(kind))
    return stays.select(*links.columns).unionByName(comes.select(*links.columns).distinct())


def drop_links(links: DataFrame, refs: DataFrame) -> DataFrame:
    """Without any link from ``refs``."""
    return links.join(refs.select("from_ref"), "from_ref", "left_anti")


def drop_session(store: Store, session_id: object) -> Store:
    """Without a session: what was remembered of it first, then its rows. Notes in folders stay."""
    sources = store["sources"]
    gone = sources.filter((F.col("session_id") == session_id) & F.col("source_type").isin(*OF_SESSIONS))
    out = drop_sources(store, gone)
    for name in SESSION_TABLES:
        if name in store:
            out[name] = store[name].filter(F.coalesce(F.col("session_id") != session_id, F.lit(True)))
    return out


def forget_folder(store: Store, root: str) -> Store:
    """Without the notes of a folder and those below it."""
    ref = F.col("source_ref")
    inside = (F.col("source_type") == "directory") & ((ref == root) | F.startswith(ref, F.lit(root.rstrip("/") + "/")))
    return drop_sources(store, store["sources"].filter(inside))


def drop_orphan_artifacts(store: Store) -> Store:
    """Without remembered artifacts that are no longer there."""
    kept = store["artifacts"].select(F.col("artifact_id").cast("string").alias("source_ref"))
    return drop_sources(store, store["sources"].filter("source_type = 'artifact'").join(kept, "source_ref", "left_anti"))


def cleared(store: Store) -> Store:
    """Without anything remembered; sessions and their rows stay."""
    return {name: df.limit(0) if name in ("sources", "chunks", "links", "edges", *BY_CHUNK) else df for name, df in store.items()}


def without_vectors(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding", F.lit(None).cast(chunks.schema["embedding"].dataType))


def drop_edge_kinds(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Without the kinds that are to be derived anew."""
    return edges.filter(~F.col("kind").isin(*kinds))


def set_where(rows: DataFrame, where: str, **values: object) -> DataFrame:
    """Rows that meet a condition with new values: pins, titles, the state of a pass."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return rows.select(*[F.when(hit, F.lit(values[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def with_defaults(sessions: DataFrame) -> DataFrame:
    """New sessions with title, a deterministic id and no pin where these aren't given."""
    key = F.sha2(F.concat_ws("\0", F.coalesce("title", F.lit("")), F.col("created_at").cast("string")), 256)
    return sessions.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), key)).withColumn("title", _filled("title", NEW_SESSION)).withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def artifact_defaults(artifacts: DataFrame) -> DataFrame:
    """New artifacts with title and type where these aren't given."""
    return artifacts.withColumn("title", _filled("title", NEW_ARTIFACT)).withColumn("content_type", _filled("content_type", PLAIN))


def sessions_by_activity(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, title, message_count, last_at: shown messages of each session, the latest active first; ties by id."""
    shown = messages.filter(F.col("role").isin("user", "assistant")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    out = sessions.join(shown, "session_id", "left")
    out = out.select("session_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("n", F.lit(0)).alias("message_count"), F.coalesce("last", "created_at").alias("last_at"))
    return out.orderBy(F.desc("last_at"), "session_id")


def memory_stats(store: Store) -> DataFrame:
    """One row: sources, chunks, chunks with a vector, terms, entities, edges, sources that wait for extraction, mean tokens of a chunk."""
    chunks = store["chunks"].agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.round(F.coalesce(F.avg("token_count"), F.lit(0.0)), 6).alias("avg_tokens"))
    sources = store["sources"].agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("entity_pass") == PENDING).alias("pending"))
    terms = store["terms"].select("term").distinct().agg(F.count(F.lit(1)).alias("terms"))
    entities = store["entities"].select("kind", "value").distinct().agg(F.count(F.lit(1)).alias("entities"))
    edges = store["edges"].agg(F.count(F.lit(1)).alias("edges"))
    out = sources
    for one in (chunks, terms, entities, edges):
        out = out.join(F.broadcast(one))  # one row each
    return out


def status(store: Store) -> DataFrame:
    """(what, name, n): edges by kind and sources by type and by state of extraction."""
    count = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(store["edges"], "edges", "kind").unionByName(count(store["sources"], "sources", "source_type")).unionByName(count(store["sources"], "extraction", "entity_pass"))


def merge_dictionary(known: DataFrame, links: DataFrame) -> DataFrame:
    """Entity dictionary (kind, value, entity_id) with the values of ``links`` added; ids follow from kind and value."""
    new = links.select("kind", "value").distinct().join(known.select("kind", "value"), ["kind", "value"], "left_anti")
    return known.unionByName(new.withColumn("entity_id", F.sha2(F.concat_ws("\0", "kind", "value"), 256)))


def add_entities(entities: DataFrame, new: DataFrame, additive: bool = True) -> DataFrame:
    """Entity links with new ones: added where they are missing, or in place of all that their chunks had."""
    keys = ["chunk_id", "kind", "value"] if additive else ["chunk_id"]
    if additive:
        return entities.unionByName(new.join(entities.select(*keys), keys, "left_anti").select(*entities.columns))
    return entities.join(new.select(*keys).distinct(), keys, "left_anti").select(*entities.columns).unionByName(new.select(*entities.columns))


def prune_dictionary(known: DataFrame, entities: DataFrame) -> DataFrame:
    """Without entities that no chunk has any more."""
    return known.join(entities.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select(*known.columns)
