"""Snapshot maintenance: upserts, cascades, sweeps and incremental differences.

Parquet snapshots are immutable: every operator returns the next snapshot, as an
anti-join of what goes and a union of what comes. Callers write it beside the old
one and switch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks are added."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def sweep_orphans(rows: DataFrame, owners: DataFrame, on: str) -> DataFrame:
    """Rows whose owner is gone are dropped."""
    return rows.join(owners.select(on), on, "left_semi")


def cascade(gone: DataFrame, chunks: DataFrame, postings: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Deleting sources (``source_id``): their chunks, postings and edges at either end, and new term counts."""
    chunks = chunks.join(gone, "source_id", "left_anti")
    ids = chunks.select("chunk_id")
    postings = postings.join(ids, "chunk_id", "left_semi")
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("chunk_id").alias(end)), end, "left_semi")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return {"chunks": chunks, "postings": postings, "edges": edges, "terms": df}


def touching(links: DataFrame, refs: DataFrame) -> DataFrame:
    """Links from or to one of the refs: two semi-joins instead of one with OR."""
    keyed = links
    out = keyed.join(refs.select(F.col("ref").alias("from_ref")), "from_ref", "left_semi")
    return out.unionByName(keyed.join(refs.select(F.col("ref").alias("to_ref")), "to_ref", "left_semi")).dropDuplicates(["from_ref", "to_ref", "heading", "raw"])


def snapshot_diff(known: DataFrame, present: DataFrame) -> DataFrame:
    """(ref, action): what a scan means for each file.

    ``unchanged`` by size and second of change, without a look at the content;
    ``touched`` if only those differ; ``changed`` by hash; ``added``; ``removed``.
    """
    k = known.select("ref", *[F.col(c).alias(f"{c}_1") for c in ("size", "mtime", "hash")], F.lit(True).alias("was"))
    p = present.select("ref", "size", "mtime", "hash", F.lit(True).alias("is_"))
    same = (F.col("size") == F.col("size_1")) & (F.date_trunc("second", "mtime") == F.date_trunc("second", "mtime_1"))
    action = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "removed").when(same, "unchanged").when(F.col("hash") == F.col("hash_1"), "touched").otherwise("changed")
    return k.join(p, "ref", "full_outer").select("ref", action.alias("action"))


def under_root(path: str, root: str) -> str:
    """SQL condition: a path is the root or below it, not merely of the same beginning."""
    return f"({path} = {root} OR startswith({path}, concat({root}, '/')))"


def folder_rollup(sources: DataFrame) -> DataFrame:
    """Notes and tokens of each folder."""
    return sources.groupBy("folder").agg(F.count(F.lit(1)).alias("notes"), F.sum("token_count").alias("tokens"))


def null_vectors(chunks: DataFrame, model: str, dims: int) -> DataFrame:
    """Vectors of another model or width are void, so that a backfill makes them anew."""
    keep = (F.col("embed_model") == model) & (F.size("embedding") == dims)
    return chunks.withColumn("embedding", F.when(keep, F.col("embedding")))
