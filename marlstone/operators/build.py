"""Building the edge graph, whole or after a change, and what it counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .entities import entity_edges
from .graph import link_edges
from .maintain import touching
from .retrieval import similar_topk

#: Neighbours and least similarity of similar edges, inferred links of a source, notes offered to an extractor.
TOP, NEAR, MAX_INFERRED, MAX_NOTES = 8, 0.7, 12, 200


def sequence(chunks: DataFrame) -> DataFrame:
    """next and prev edges between chunks of a source whose ord differs by one."""
    after = chunks.select("source_id", (F.col("ord") - 1).alias("ord"), F.col("chunk_id").alias("b"))
    pairs = chunks.select("source_id", "ord", F.col("chunk_id").alias("a")).join(after, ["source_id", "ord"])
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("next").alias("kind")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit("prev").alias("kind"))))
    return pairs.select(both.alias("e")).select("e.src", "e.dst", "e.kind", F.lit(1.0).alias("weight"))


def linked(links: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges of resolved links; inferred ones, located by their quote, under their own kind."""
    of_notes = sources.filter("source_type = 'directory'").select("source_id", F.col("source_ref").alias("ref"))
    return link_edges(links, chunks.join(of_notes, "source_id"))


def shared_entities(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = entities.join(chunks.select("chunk_id", "source_id"), "chunk_id")
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    return entity_edges(rows, n, id_col="chunk_id", source_col="source_id").select("src", "dst", F.lit("entity").alias("kind"), "weight")


def similar(chunks: DataFrame, changed: DataFrame | None = None, k: int = TOP, least: float = NEAR) -> DataFrame:
    """Mutual nearest chunks of other sources, both ways.

    With ``changed`` (chunk_id) only pairs that touch these: their neighbours are
    asked for theirs, as an edge needs both.  Numbers stand in for ids inside.
    """
    numbered = cut(chunks.filter("embedding is not null").select("chunk_id", F.xxhash64("chunk_id").alias("vec_id"), F.xxhash64("source_id").alias("label"), "embedding"), "numbered")
    if changed is None:
        found = similar_topk(numbered, k, least)
    else:
        asked = numbered.join(changed.select("chunk_id"), "chunk_id", "left_semi")
        near = similar_topk(numbered, k, least, asked)
        far = numbered.join(near.select(F.col("dst").alias("vec_id")).distinct(), "vec_id", "left_semi").join(changed.select("chunk_id"), "chunk_id", "left_anti").select(*numbered.columns)
        found = near.unionByName(similar_topk(numbered, k, least, far))
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = found.join(back, ["src", "dst"], "left_semi")
    if changed is not None:
        mine = changed.select(F.xxhash64("chunk_id").alias("src"))
        one = pairs.join(mine, "src", "left_semi")
        pairs = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity")).distinct()
    name = lambda end: numbered.select(F.col("vec_id").alias(end), F.col("chunk_id").alias(f"{end}_id"))
    out = pairs.join(name("src"), "src").join(name("dst"), "dst")
    return out.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.lit("similar").alias("kind"), F.col("similarity").alias("weight"))


def build_edges(sources: DataFrame, chunks: DataFrame, links: DataFrame | None, entities: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """All edges: sequence, links, shared entities, similar. Without ``links`` those of ``old`` stay."""
    authored = linked(links, chunks, sources) if links is not None else old.filter(F.col("kind").isin("link", "link_inferred"))
    return sequence(chunks).unionByName(authored).unionByName(shared_entities(entities, chunks)).unionByName(similar(chunks))


def update_edges(edges: DataFrame, sources: DataFrame, chunks: DataFrame, links: DataFrame, entities: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after the sources in ``changed`` (source_id) got new chunks.

    Edges that end in chunks that are gone are dropped.  Sequence edges of the
    changed sources, links that touch them in either direction and similar pairs
    with their chunks are made anew; entity edges are all rebuilt, as which a chunk
    keeps depends on all.  A place that a lost chunk leaves among another's nearest
    is filled by the next full build.
    """
    ids = chunks.select("chunk_id")
    stays = edges.filter("kind <> 'entity'")
    for end in ("src", "dst"):
        stays = stays.join(ids.select(F.col("chunk_id").alias(end)), end, "left_semi")
    of_changed = chunks.join(changed.select("source_id"), "source_id", "left_semi")
    refs = sources.filter("source_type = 'directory'").join(changed.select("source_id"), "source_id", "left_semi").select(F.col("source_ref").alias("ref"))
    made = sequence(of_changed).unionByName(linked(touching(links, refs), chunks, sources)).unionByName(similar(chunks, of_changed))
    keys = ["src", "dst", "kind"]
    stays = stays.select("src", "dst", "kind", "weight").join(made.select(*keys), keys, "left_anti")
    return stays.unionByName(made).unionByName(shared_entities(entities, chunks))


def link_report(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: links, those without a target, with a note without chunks at an end, with a heading that no chunk has, and the unresolved share."""
    refs = chunks.select("ref").distinct()
    rows = links.join(refs.select(F.col("ref").alias("from_ref"), F.lit(True).alias("has_from")), "from_ref", "left").join(refs.select(F.col("ref").alias("to_ref"), F.lit(True).alias("has_to")), "to_ref", "left")
    want = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    headed = links.filter(want != "").select("to_ref", want.alias("want")).distinct().join(chunks.select(F.col("ref").alias("to_ref"), F.lower(F.coalesce("heading_path", F.lit(""))).alias("path")), "to_ref").filter(F.contains("path", "want")).select("to_ref", "want", F.lit(True).alias("met")).distinct()
    rows = rows.withColumn("want", want).join(headed, ["to_ref", "want"], "left")
    resolved = F.coalesce("to_ref", F.lit("")) != ""
    ends = F.coalesce(F.col("has_from") & F.col("has_to"), F.lit(False))
    out = rows.agg(F.count(F.lit(1)).alias("links"), F.count_if(~resolved).alias("unresolved"), F.count_if(resolved & ~ends).alias("no_chunk"), F.count_if(resolved & ends & (F.col("want") != "") & F.col("met").isNull()).alias("heading_missed"))
    return out.withColumn("unresolved_share", F.when(F.col("links") > 0, F.round(F.col("unresolved") / F.col("links"), 6)).otherwise(F.lit(0.0)))


def guard_links(proposed: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """Proposed cross-references (source_id, pos, target, evidence) with to_ref and ``reject_reason``.

    ``sources``: source_id, source_ref, text; ``resolved``: target, to_ref.  In this
    order: no target, evidence that isn't in the text, a target that is no note, the
    source itself, a target named before, more than twelve.
    """
    rows = proposed.withColumn("target", F.trim(F.coalesce("target", F.lit("")))).withColumn("evidence", F.trim(F.coalesce("evidence", F.lit(""))))
    quoted = (F.col("evidence") != "") & F.contains("low", F.lower("evidence"))
    # Texts end here: further on every proposal would carry its own copy through the shuffles.
    rows = rows.join(sources.select("source_id", "source_ref", F.lower(F.coalesce("text", F.lit(""))).alias("low")), "source_id").withColumn("quoted", quoted).drop("low")
    rows = rows.join(resolved.select("target", "to_ref").distinct(), "target", "left")
    reason = F.when(F.col("target") == "", "no target").when(~F.col("quoted"), "no evidence").when(F.col("to_ref").isNull(), "unresolved").when(F.col("to_ref") == F.col("source_ref"), "itself")
    rows = rows.withColumn("reject_reason", reason).drop("quoted", "source_ref")
    good = F.col("reject_reason").isNull()
    again = F.row_number().over(Window.partitionBy("source_id", "reject_reason", "to_ref").orderBy("pos"))
    rows = rows.withColumn("reject_reason", F.when(good & (again > 1), "repeated").otherwise(F.col("reject_reason")))
    place = F.row_number().over(Window.partitionBy("source_id", "reject_reason").orderBy("pos"))
    return rows.withColumn("reject_reason", F.when(good & (place > MAX_INFERRED), "over the limit").otherwise(F.col("reject_reason")))


def inferred_links(guarded: DataFrame, sources: DataFrame) -> DataFrame:
    """Accepted cross-references as links whose quote says where they stand."""
    rows = guarded.filter("reject_reason is null").join(sources.select("source_id", F.col("source_ref").alias("from_ref")), "source_id")
    return rows.select("from_ref", "to_ref", F.lit("").alias("heading"), F.col("evidence").alias("raw"), F.lit(False).alias("embed"), F.lit("link_inferred").alias("kind"), "pos")


def note_names(refs: DataFrame, own: str, most: int = MAX_NOTES) -> DataFrame:
    """(ref, name) of the notes that an extractor may name: the first ``most`` by reference, but not its own."""
    name = F.regexp_replace(F.regexp_extract("ref", r"([^/]*)$", 1), r"(\.markdown)?$", "")
    return refs.filter(F.col("ref") != own).orderBy("ref").limit(most).select("ref", F.regexp_replace(name, r"\.md$", "").alias("name"))


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how many pairs two partitions of the rows agree on, from counts of groups instead of pairs."""
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both, of_a, of_b = pairs(cells), pairs(cells.groupBy(a).agg(F.sum("n").alias("n"))), pairs(cells.groupBy(b).agg(F.sum("n").alias("n")))
    total = pairs(cells.agg(F.sum("n").alias("n")))
    one = total.select(F.col("p").alias("t")).join(F.broadcast(both.select(F.col("p").alias("ab")))).join(F.broadcast(of_a.select(F.col("p").alias("pa")))).join(F.broadcast(of_b.select(F.col("p").alias("pb"))))
    return one.select(F.when(F.col("t") > 0, F.round((F.col("t") + 2 * F.col("ab") - F.col("pa") - F.col("pb")) / F.col("t"), 6)).otherwise(F.lit(1.0)).alias("rand_index"))
