"""The typed edge graph: sequence, links, bounded walks, backlinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: What a step along each kind of edge leaves of a score; other kinds are ignored.
DECAY = {"link": 0.6, "next": 0.5, "prev": 0.5, "similar": 0.4, "link_inferred": 0.35, "entity": 0.3}
BOTH_WAYS = ("link", "link_inferred")
INFERRED, UNSURE = 0.8, 0.85  # weights of an inferred link and of one whose place isn't certain
MAX_DEPTH, MAX_SEEDS, MAX_FRONTIER, MAX_VISITED, LEAST_SCORE, CO_ARRIVAL = 2, 10, 30, 200, 1e-4, 0.25


def sequence_edges(chunks: DataFrame, source_col: str = "doc_id") -> DataFrame:
    """next and prev edges between chunks whose ord differs by one; gaps in ord part them."""
    after = chunks.select(source_col, (F.col("ord") - 1).alias("ord"), F.col("ord").alias("ord_2"))
    pairs = chunks.select(source_col, "ord").join(after, [source_col, "ord"])
    both = F.explode(F.array(F.struct(F.col("ord").alias("src_ord"), F.col("ord_2").alias("dst_ord"), F.lit("next").alias("kind")), F.struct(F.col("ord_2").alias("src_ord"), F.col("ord").alias("dst_ord"), F.lit("prev").alias("kind"))))
    return pairs.select(source_col, both.alias("e")).select(source_col, "e.*", F.lit(1.0).alias("weight"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces what ``old`` has for the same (src, dst, kind)."""
    return old.join(new, ["src", "dst", "kind"], "left_anti").unionByName(new)


def backlinks(edges: DataFrame) -> DataFrame:
    """Link edges seen from their targets."""
    links = edges.filter(F.col("kind").isin(*BOTH_WAYS))
    return links.select(F.col("dst").alias("node"), F.col("src").alias("linked_from"), "kind", "weight")


def steps(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, gain) of every usable step: links lead both ways."""
    known = edges.filter(F.col("kind").isin(*DECAY))
    both = known.unionByName(known.filter(F.col("kind").isin(*BOTH_WAYS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight"))
    decay = F.create_map(*[F.lit(x) for kv in DECAY.items() for x in kv])
    return both.select("src", "dst", "kind", (F.col("weight") * decay[F.col("kind")]).alias("gain"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH, frontier: int = MAX_FRONTIER, visited: int = MAX_VISITED) -> DataFrame:
    """(node, score, hops, via): where a bounded walk from (node, score) seeds gets.

    A step multiplies by the edge's weight and its kind's decay; scores below the
    least are dropped. The earliest hop that reaches a node settles it, with its
    best score there; only the best ``frontier`` of a hop go on and count as
    visited, others may be reached again. Seeds are the best ten and never
    return. ``via`` is the kind of the edge that gave the score. Frontier and visited are bounded, so they are broadcast against edges.
    """
    moves = steps(edges)
    front = seeds.select("node", "score").orderBy(F.desc("score"), "node").limit(MAX_SEEDS)
    seen = front.select("node", F.lit(0).alias("hops"), "score", F.lit("").alias("via"))
    for hop in range(1, depth + 1):
        reached = moves.join(F.broadcast(front), moves.src == front.node).select(F.col("dst").alias("node"), "kind", (F.col("score") * F.col("gain")).alias("score"))
        best = reached.filter(F.col("score") >= LEAST_SCORE).groupBy("node").agg(F.max("score").alias("score"), F.max_by("kind", F.struct("score", "kind")).alias("via")).join(F.broadcast(seen.select("node")), "node", "left_anti")
        front = cut(best.orderBy(F.desc("score"), "node").limit(frontier), "frontier")
        seen = seen.unionByName(front.select("node", F.lit(hop).alias("hops"), "score", "via"))
    found = seen.filter("hops > 0").orderBy("hops", F.desc("score"), "node").limit(max(0, visited))
    return found.select("node", "score", "hops", "via")


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Link targets to note paths: by path, then alias, then a basename that only one note has.

    ``links``: from_ref, target; ``notes``: path, aliases. Lower case, without ``.md``.
    """
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\\", "/"), r"\.(md|markdown)$", "")
    keyed = notes.select("path", norm(F.col("path")).alias("key"), "aliases")
    by_path = keyed.select(F.col("key").alias("want"), F.col("path").alias("hit_path"))
    by_alias = keyed.select(F.explode("aliases").alias("a"), "path").select(norm(F.col("a")).alias("want"), "path").groupBy("want").agg(F.min("path").alias("hit_alias"))
    base = keyed.groupBy(F.regexp_extract("key", r"([^/]+)$", 1).alias("want")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("hit_base")).filter("n = 1").drop("n")
    wanted = links.withColumn("want", norm(F.col("target")))
    out = wanted.join(by_path, "want", "left").join(by_alias, "want", "left").join(base, "want", "left")
    how = F.when(F.col("hit_path").isNotNull(), "path").when(F.col("hit_alias").isNotNull(), "alias").when(F.col("hit_base").isNotNull(), "basename").otherwise("missing")
    return out.select(*links.columns, F.coalesce("hit_path", "hit_alias", "hit_base").alias("to_ref"), how.alias("resolved_by"))


def link_edges(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): chunks of each resolved link to the chunk it means.

    ``links``: from_ref, to_ref, heading, raw, embed, kind (``link`` where null), pos
    (its place among the links); ``chunks``: chunk_id, ref, ord, text, heading_path.
    An edge leaves every chunk that holds the link as written, or the first if none
    does; it ends at the first chunk under the heading (whole path or its last part,
    else a part of it), else at the first. A heading that is found and an embedded
    note weigh 1, everything else 0.85, inferred links 0.8 under a kind of their
    own. Edges to themselves are dropped; of several between two chunks the first
    link's stays. Links to or from notes without chunks give nothing.
    """
    kind = F.when(F.col("kind") == "link_inferred", "link_inferred").otherwise("link")
    links = links.select("from_ref", "to_ref", F.trim(F.coalesce("heading", F.lit(""))).alias("heading"), F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("embed", F.lit(False)).alias("embed"), kind.alias("kind"), "pos")
    keys = ["from_ref", "to_ref", "heading", "raw", "embed", "kind"]
    links = links.groupBy(*keys).agg(F.min("pos").alias("pos"))  # written twice in a note, it is one assertion
    c = chunks.select("chunk_id", "ref", "ord", "text", "heading_path")
    firsts = c.groupBy("ref").agg(F.min_by("chunk_id", "ord").alias("first"))
    held = F.contains("text", "raw") & (F.trim("raw") != "")
    holding = links.join(c, links.from_ref == c.ref).filter(held).select(*keys, "pos", F.col("chunk_id").alias("src"))
    other = links.join(holding.select(*keys), keys, "left_anti").join(firsts, F.col("from_ref") == F.col("ref")).select(*keys, "pos", F.col("first").alias("src"))
    src = holding.unionByName(other)
    path, want = F.lower(F.coalesce("heading_path", F.lit(""))), F.lower(F.col("heading"))
    match = F.when(want == "", 3).when((path == want) | F.endswith(path, F.concat(F.lit(" › "), want)), 0).when(F.contains(path, want), 1).otherwise(3)
    dst = links.join(c, links.to_ref == c.ref).withColumn("match", match)
    dst = dst.groupBy(*keys).agg(F.min_by(F.struct("chunk_id", "match"), F.struct("match", "ord")).alias("d"))
    weight = F.when(F.col("kind") == "link_inferred", INFERRED).when((F.col("d.match") < 3) | ((F.col("heading") == "") & F.col("embed")), 1.0).otherwise(UNSURE)
    out = src.join(dst, keys).select("src", F.col("d.chunk_id").alias("dst"), "kind", weight.alias("weight"), F.struct("from_ref", "pos", "raw").alias("place"))
    return out.filter("src <> dst").groupBy("src", "dst").agg(F.min_by(F.struct("kind", "weight"), "place").alias("e")).select("src", "dst", "e.kind", "e.weight")


def co_arrival(expansions: DataFrame, fused: DataFrame) -> DataFrame:
    """Fused scores of candidates, raised by a quarter of the score of a walk that reaches them too."""
    hits = expansions.select("node", F.col("score").alias("arrived"))
    out = fused.join(F.broadcast(hits), fused.doc_id == hits.node, "left")
    return out.select(*[c for c in fused.columns if c != "fused"], (F.col("fused") + CO_ARRIVAL * F.coalesce("arrived", F.lit(0.0))).alias("fused"))
