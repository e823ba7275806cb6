"""Search tables that are kept: texts are tokenised once, and a query reads what its words need.

Below one folder stand ``postings`` (by term), ``values`` (entity values) and
``texts`` (by id), each dealt into parts by a hash and sorted inside, so that the
parts' names and the files' statistics prune a scan to the terms, values or ids
of a query.  Updates are written as further deltas; ``gone`` says which documents
of earlier deltas no longer count.  ``build`` on the whole corpus compacts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity_array, query_ngrams, terms, token_count
from ..plans.lineage import cut, release
from .retrieval import scored

PARTS = 64


def _part(c: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")


@dataclass
class Index:
    """Where the tables are and into how many parts they are dealt."""

    spark: SparkSession
    path: str
    parts: int = PARTS

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        gone = self.spark.read.schema("doc_id long, upto int").parquet(f"{self.path}/gone").groupBy("doc_id").agg(F.max("upto").alias("upto"))
        live = rows.join(gone.withColumnRenamed("doc_id", "_gone"), (F.col("doc_id") == F.col("_gone")) & (F.col("delta") < F.col("upto")), "left_anti")
        return live.drop("delta")

    def pruned(self, name: str, key: str, wanted: list) -> DataFrame:
        """Rows whose key is among a bounded list: by parts, then by the files' statistics."""
        parts = [r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], f"k {'long' if key == 'doc_id' else 'string'}").select(_part(F.col("k"), self.parts)).distinct().collect()] if wanted else []
        return self.read(name).filter(F.col("part").isin(parts) & F.col(key).isin(wanted)).drop("part")


def _write(index: Index, documents: DataFrame, delta: int) -> None:
    text = F.coalesce("text", F.lit(""))
    values = F.array_distinct(F.transform(entity_array(text), lambda e: e["value"]))
    rows = documents.select(F.col("doc_id").cast("long"), "source", text.alias("text"), F.greatest(token_count(text), F.lit(1)).alias("dl"), token_count(text).alias("tokens"))
    found = rows.select("doc_id", "dl", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Written first: sizes, filters and rows of an array would each find its entities again.
    arrays = cut(rows.select("doc_id", values.alias("values")), "values")
    held = arrays.select("doc_id", F.size("values").alias("n"), F.explode("values").alias("value"))
    for name, table, key in (("postings", found, "term"), ("values", held, "value"), ("texts", rows, "doc_id")):
        dealt = table.withColumn("part", _part(F.col(key), index.parts))
        # A part's rows of one document or term may be many: they are dealt by the key, not by the part.
        dealt.repartition("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(8))).sortWithinPartitions("part", key).withColumn("delta", F.lit(delta)).write.mode("append").partitionBy("delta", "part").option("compression", "zstd").parquet(f"{index.path}/{name}")
    release(arrays)


def build(documents: DataFrame, path: str, parts: int = PARTS) -> Index:
    """A new index of (doc_id, text, source) below an empty folder. Null texts count as empty; ids are unique."""
    index = Index(documents.sparkSession, path, parts)
    index.spark.createDataFrame([], "doc_id long, upto int").write.parquet(f"{path}/gone")
    _write(index, documents, 0)
    return index


def update(index: Index, documents: DataFrame, removed: DataFrame) -> None:
    """Documents take the places of those with their ids; ``removed`` (doc_id) go."""
    last = index.spark.read.parquet(f"{index.path}/texts").select(F.max("delta")).first()[0]
    delta = (last if last is not None else -1) + 1
    gone = documents.select(F.col("doc_id").cast("long")).unionByName(removed.select(F.col("doc_id").cast("long"))).distinct()
    gone.select("doc_id", F.lit(delta).cast("int").alias("upto")).write.mode("append").parquet(f"{index.path}/gone")
    _write(index, documents, delta)


def _list(query: DataFrame, c: Column) -> list[str]:
    """Distinct values that one query's text gives: as many as it has words, at most four for each."""
    return sorted({v for r in query.limit(1).select(c.alias("v")).collect() for v in r["v"]})


def bm25(index: Index, query: DataFrame, k: int | None = 20) -> DataFrame:
    """doc_id and score of the documents that share one of the query's rarest terms, best first."""
    stats = index.read("texts").agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("tokens"), F.lit(0.0)), F.lit(1.0)).alias("avg_tokens"))
    return scored(index.pruned("postings", "term", _list(query, terms(F.col("text")))), stats, k)


def entity_signal(index: Index, query: DataFrame) -> DataFrame:
    """doc_id and ``entity``: Jaccard similarity of a document's entity values with those that the query names."""
    told = _list(query, F.transform(entity_array(F.col("text")), lambda e: e["value"]))
    rows = index.pruned("values", "value", sorted({*told, *_list(query, query_ngrams(F.col("text")))}))
    known = rows.select("value").distinct()
    if told:
        known = known.unionByName(index.spark.createDataFrame([(t,) for t in told], "value string")).distinct()
    asked = known.agg(F.count(F.lit(1)).alias("asked"))
    shared = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("shared")).join(F.broadcast(asked))
    return shared.select("doc_id", F.round(F.col("shared") / (F.col("n") + F.col("asked") - F.col("shared")), 6).alias("entity"))


def texts(index: Index, ids: list[int]) -> DataFrame:
    """doc_id, source, text of a bounded list of documents."""
    return index.pruned("texts", "doc_id", ids).select("doc_id", "source", "text")
