"""Exact top-k search by MaxScore over quantised vectors.

A dimension is a query term; its postings are the vectors that have something
to add there, that is whose component has the sign of the query's.  The largest
addition in a shard bounds a term.  Terms in ascending order of their bounds
are non-essential as long as their bounds add up to less than the k-th best
score so far: a vector in none of the other, essential, postings can't get
among the best.  Essential terms are scored for blocks of vectors, the others
are probed from the largest bound down while a vector is still competitive.

Each block of queries meets each shard of vectors once, both of bounded size;
the best k of every shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut
from .vectors import PACKED, packed, unpack, usable

SCALE, K = 256, 5
SHARD_ROWS, QUERY_ROWS, STEP, PROBE = 8192, 256, 2048, 8
_EXACT = float(1 << 53)


def quantise(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as whole doubles."""
    return np.floor(vectors * SCALE)


class Shard:
    """Quantised vectors of one shard with the extremes of each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.high, self.low = np.maximum(rows.max(axis=0), 0), np.minimum(rows.min(axis=0), 0)
        self.steps = [(lo, np.ascontiguousarray(self.rows[lo : lo + STEP].T)) for lo in range(0, len(rows), STEP)]

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows with another id, best first, ties to the smaller id."""
        bound = np.where(query > 0, query * self.high, query * self.low)
        order = np.argsort(bound, kind="stable")
        bound, terms = bound[order], order[query[order] != 0]
        bound = bound[len(bound) - len(terms) :]
        upto = np.concatenate([[0.0], np.cumsum(bound)])
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0), -np.inf
        for lo, columns in self.steps:
            # Strictly less: a tie can still win by its id.
            spare = int(np.searchsorted(upto, least, "left")) - 1 if least > 0 else 0
            spare = max(0, min(spare, len(terms)))
            essential = terms[spare:]
            got = query[essential] @ columns[essential] if len(essential) else np.zeros(columns.shape[1])
            live = np.flatnonzero((got + upto[spare] >= least) & (self.ids[lo : lo + columns.shape[1]] != own))
            got = got[live]
            while spare and len(live):
                step = max(0, spare - PROBE)
                part = terms[step:spare]
                got = got + query[part] @ columns[part[:, None], live[None, :]]
                spare = step
                on = got + upto[spare] >= least
                live, got = live[on], got[on]
            ids, scores = np.concatenate([ids, self.ids[lo + live]]), np.concatenate([scores, got])
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            if len(ids) == k:
                least = scores.min()
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top]


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for r in range(batch.num_rows):
                q_ids, queries = unpack(batch.column(0)[r], batch.column(1)[r], batch.column(2)[r].as_py(), batch.column(3)[r].as_py())
                ids, rows = unpack(batch.column(4)[r], batch.column(5)[r], batch.column(6)[r].as_py(), batch.column(7)[r].as_py())
                d = max(queries.shape[1], rows.shape[1])
                queries, rows = (quantise(np.pad(x, ((0, 0), (0, d - x.shape[1])))) for x in (queries, rows))
                if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(d, 1) >= _EXACT:
                    # Products too large for doubles: whole numbers of any size.
                    queries, rows = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (queries, rows))
                shard = Shard(ids, rows)
                for i, own in enumerate(q_ids.tolist()):
                    found, scores = shard.best(own, queries[i], k)
                    out[0] += [own] * len(found)
                    out[1] += [batch.column(8)[r].as_py() * QUERY_ROWS + i] * len(found)
                    out[2] += found.tolist()
                    out[3] += [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "query_no", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the queries: rows whose id is divisible by ``every``.

    The score is the integer inner product; equal scores go to the smaller
    vec_id.  Rows with a query's id are its own and no candidates for it; other
    repeated rows are candidates one by one, and repeated queries are answered
    one by one.  Null ids, null vectors and those with a null or non-finite
    component take no part.  A shorter vector counts as ending with zeros.
    Scores beyond 64 bits become the largest or smallest of them.  Without
    queries or candidates the result is empty.
    """
    bound_batches(rows.sparkSession)
    good = usable(rows, id_col, vector_col)
    shards = cut(good.mapInArrow(packed(SHARD_ROWS), PACKED).withColumn("no", F.monotonically_increasing_id()), "shards")
    blocks = cut(good.filter(F.pmod("id", F.lit(every)) == 0).mapInArrow(packed(QUERY_ROWS), PACKED).withColumn("block", F.monotonically_increasing_id()), "queries")
    lanes = max(1, min(256, shards.count()))
    left = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "n", "d")], "block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    right = shards.withColumn("lane", F.pmod(F.xxhash64("no"), F.lit(lanes)).cast("int"))
    # Merged, never broadcast: the optimiser sees the size of the blocks' files, not that of their copies for all lanes.
    met = left.join(right.hint("merge"), "lane").select("q_ids", "q_vectors", "q_n", "q_d", "ids", "vectors", "n", "d", "block")
    found = met.mapInArrow(_searched(k), "query_id long, query_no long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best ``embeddings`` rows for every fiftieth."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The definition itself, by brute force.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
