"""Entity tables: links of rows to entities, rare entities and edges between rows that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entities, entity_array, query_ngrams
from ..plans.lineage import cut

#: An entity is rare up to this many rows; a row keeps this many entity edges.
RARE, PER_ROW = 12, 12


def entity_counts(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, value, count) of heuristic entities."""
    return entities(documents.withColumn("text", F.coalesce("text", F.lit(""))), id_col, "text")


def dictionary(links: DataFrame) -> DataFrame:
    """Distinct (kind, value) with a deterministic id."""
    return links.select("kind", "value").distinct().withColumn("entity_id", F.sha2(F.concat_ws("\0", "kind", "value"), 256))


def rare_entities(links: DataFrame, id_col: str = "doc_id", most: int = RARE) -> DataFrame:
    """(kind, value, df) of entities in 2 to ``most`` rows: filtered before anything pairs up."""
    return links.groupBy("kind", "value").agg(F.countDistinct(id_col).alias("df")).filter(F.col("df").between(2, most))


def entity_edges(links: DataFrame, n_rows: DataFrame, id_col: str = "doc_id", source_col: str | None = None, floor: float = 0.0) -> DataFrame:
    """(src, dst, weight): rows of different sources that share a rare entity, both ways.

    The weight is ln(N / df) / ln N, at most 1; of several shared entities the
    heaviest counts; each row keeps its twelve heaviest. As rare entities are in at
    most twelve rows, each gives a bounded number of pairs.
    """
    source = source_col or id_col
    # Looked at three times, and finding entities costs far more than writing them.
    links = cut(links.select(*dict.fromkeys((id_col, source, "kind", "value"))), "links")
    rare = rare_entities(links, id_col)
    rows = links.join(rare, ["kind", "value"]).select(F.col(id_col).alias("row"), F.col(source).alias("source"), "kind", "value", "df")
    other = rows.select(F.col("row").alias("dst"), F.col("source").alias("source_2"), "kind", "value")
    pairs = rows.join(other, ["kind", "value"]).filter("source <> source_2").join(F.broadcast(n_rows.select(F.col(n_rows.columns[0]).alias("n"))))
    weight = F.when(F.col("n") > 1, F.least(F.lit(1.0), F.log(F.col("n") / F.col("df")) / F.log(F.col("n").cast("double")))).otherwise(F.lit(1.0))
    best = pairs.groupBy(F.col("row").alias("src"), "dst").agg(F.round(F.max(weight), 6).alias("weight")).filter(F.col("weight") > floor)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= PER_ROW).select("src", "dst", "weight")


def query_entities(query: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct values that a query names: its heuristic entities and those of its n-grams that the dictionary knows."""
    grams = query.select(F.explode(query_ngrams(F.col("text"))).alias("value"))
    told = query.select(F.explode(F.transform(entity_array(F.col("text")), lambda e: e["value"])).alias("value"))
    return known.select("value").join(F.broadcast(grams.distinct()), "value", "left_semi").unionByName(told).distinct()


def entity_jaccard(links: DataFrame, values: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Jaccard similarity of each row's entity values with those of the query, where they meet."""
    asked = values.agg(F.count(F.lit(1)).alias("asked"))
    rows = links.select(id_col, "value").distinct()
    shared = rows.join(F.broadcast(values), "value", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("shared"))
    sizes = rows.join(shared.select(id_col), id_col, "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    out = shared.join(sizes, id_col).join(F.broadcast(asked))
    return out.select(id_col, (F.col("shared") / (F.col("n") + F.col("asked") - F.col("shared"))).alias("jaccard"))
