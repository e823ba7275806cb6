"""Lexical and vector retrieval: postings, BM25, exact k-NN and similarity edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms, token_count
from ..plans.lineage import bound_batches, cut
from .tiles import meet, split

#: BM25 saturation and length weights, and how many of a query's rarest terms probe.
K1, B, PROBES = 1.2, 0.75, 12
BLOCK = 1024
#: Bytes of a tile of vectors, least numbers of tiles, parts and lanes of a large input, pairs that are worked out at once.
TILE_BYTES, TILES, PARTS, LANES, PAIRS = 48 << 20, 32, 2, 64, 16384


def term_freq(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Postings: id, term, tf. Counts are combined before they are shuffled."""
    rows = documents.select(id_col, F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    return rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_df(postings: DataFrame) -> DataFrame:
    """In how many documents each term is; postings hold a pair once, so rows are counted."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: number of documents, tokens and their average."""
    n = token_count(F.coalesce("text", F.lit("")))
    return documents.select(n.alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.greatest(F.coalesce(F.avg("n"), F.lit(0.0)), F.lit(1.0)).alias("avg_tokens"))


def idf(n: Column, df: Column) -> Column:
    return F.when(df <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))))


def rare_probe(query: DataFrame, frequencies: DataFrame, probes: int = PROBES) -> DataFrame:
    """The query's rarest known terms: term, df."""
    wanted = query.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return frequencies.join(wanted, "term", "left_semi").orderBy("df", "term").limit(probes)


def bm25(documents: DataFrame, query: DataFrame, k: int | None = 20) -> DataFrame:
    """doc_id and score of the documents that share a probe term, best first.

    One pass over the texts leaves each document's length and its occurrences of the
    query's terms; frequencies, averages and scores come from that narrow table. The
    query's terms are one row and the probes at most ``PROBES``, so both are broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    asked = query.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).agg(F.collect_set("term").alias("asked"))
    held = F.filter("terms", lambda t: F.array_contains(F.col("asked"), t))
    rows = documents.select("doc_id", terms(text).alias("terms"), token_count(text).alias("tokens")).join(F.broadcast(asked)).select("doc_id", "tokens", held.alias("held"))
    rows = cut(rows, "lengths")
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("tokens"), F.lit(0.0)), F.lit(1.0)).alias("avg_tokens"))
    hits = rows.select("doc_id", F.greatest("tokens", F.lit(1)).alias("dl"), F.explode("held").alias("term"))
    return scored(hits.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), stats, k)


def scored(postings: DataFrame, stats: DataFrame, k: int | None) -> DataFrame:
    """doc_id and score from a query's postings (doc_id, dl, term, tf) and one row of statistics: its rarest terms count."""
    probes = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy("df", "term").limit(PROBES)
    rows = postings.join(F.broadcast(probes), "term").join(F.broadcast(stats))
    part = idf(F.col("n_docs"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_tokens")))
    out = rows.groupBy("doc_id").agg(F.sum(part).alias("score"))
    return out if k is None else out.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(k)


def bm25_many(documents: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, doc_id and score: the ``k`` best documents of each query (query_id, text).

    One pass over the texts gives the postings of words that any query holds; each
    query scores by its own rarest terms. Nothing is collected or broadcast by hint,
    so queries can be many; a hot term's postings are a written table, which AQE
    splits. Documents that share no probe term with a query have no row, nor have
    queries without a known term.
    """
    text = F.coalesce("text", F.lit(""))
    wanted = cut(queries.select("query_id", F.explode(F.array_distinct(terms(text))).alias("term")), "wanted")
    # Lengths stand below the explosion, else they are worked out for every word.
    rows = documents.select("doc_id", F.greatest(token_count(text), F.lit(1)).alias("dl"), terms(text).alias("terms")).select("doc_id", "dl", F.explode("terms").alias("term"))
    tf = cut(rows.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    by_rarity = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    probes = wanted.join(term_df(tf), "term").withColumn("r", by_rarity).filter(F.col("r") <= PROBES).drop("r")
    stats = corpus_stats(documents).select("n_docs", "avg_tokens")
    part = idf(F.col("n_docs"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_tokens")))
    scores = tf.join(probes, "term").join(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a length is 0 or lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(x, x) * dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norms > 0), dot(x, y) / norms).otherwise(F.lit(0.0))


def knn(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """vec_id, label and similarity of the ``k`` vectors nearest to the one query row."""
    q = query.select(F.col("embedding").alias("q")).limit(1)
    scored = vectors.filter(F.col("embedding").isNotNull()).join(F.broadcast(q)).select("vec_id", "label", cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    return scored.orderBy(F.desc(F.round("similarity", 6)), "vec_id").limit(k)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of numbers from one flat buffer; shorter ones end with zeros, and nulls count as zero."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Vectors:
    """Unit vectors of up to ``BLOCK`` rows (id, label, vector), in double and single precision."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.labels = (batch.column(c).to_numpy().astype(np.int64) for c in (1, 2))
        vectors = _matrix(batch.column(3))
        norms = np.linalg.norm(vectors, axis=1)[:, None]
        self.exact = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        self.rough = self.exact.astype(np.float32)


class _Nearest(_Vectors):
    """Rows that are asked for their ``k`` nearest of other labels, of at least ``least``, among blocks that come by in order of ids."""

    def __init__(self, batch: pa.RecordBatch, k: int, least: float):
        super().__init__(batch)
        self.k, self.least = k, least
        self.sims, self.found = np.full((len(self.ids), k), -np.inf), np.zeros((len(self.ids), k), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bound(self) -> np.ndarray:
        """What a rounded similarity must reach to count: ids ascend, so one equal to the last of ``k`` comes too late, and none is above 1."""
        last = self.sims[:, -1]
        return np.where(last >= 1, np.inf, np.where(last > -np.inf, last + 1e-6, self.least))

    def passing(self, other: _Vectors, d: int, bound: np.ndarray, scratch: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that reach the bound in single precision, which errs by less than the slack; found eight at a time."""
        shape = len(self.ids), len(other.ids)
        n = shape[0] * shape[1]
        sims, ok = scratch[0][:n].reshape(shape), scratch[1][: -(-n // 8) * 8]
        np.matmul(self.rough[:, :d], other.rough[:, :d].T, out=sims)
        ok[n:] = False
        slack = 6e-7 + (d + 8) * 2.0**-23
        np.greater_equal(sims, (bound - slack).astype(np.float32)[:, None], out=ok[:n].reshape(shape))
        at = (np.flatnonzero(ok.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        i, j = np.divmod(at[ok[at]], shape[1])
        apart = self.labels[i] != other.labels[j]
        return i[apart], j[apart]

    def meet(self, other: _Vectors, scratch: tuple[np.ndarray, np.ndarray]) -> None:
        d, bound = min(self.exact.shape[1], other.exact.shape[1]), self.bound()
        i, j = self.passing(other, d, bound, scratch)
        if len(i) > len(self.ids) * len(other.ids) // 16:
            sims = np.round(self.exact[:, :d] @ other.exact[:, :d].T, 6)
            sims[self.labels[:, None] == other.labels[None, :]] = -np.inf
            ok = sims >= bound[:, None] - 5e-7
            if ok.sum() > 8 * self.k * len(self.ids):
                best = np.argsort(-sims, axis=1, kind="stable")[:, : self.k]
                among = np.zeros(ok.shape, bool)
                np.put_along_axis(among, best, True, axis=1)
                ok &= among
            i, j = np.nonzero(ok)
            sims = sims[i, j]
        else:
            parts = [np.einsum("ij,ij->i", self.exact[i[at : at + PAIRS], :d], other.exact[j[at : at + PAIRS], :d]) for at in range(0, len(i), PAIRS)]
            sims = np.round(np.concatenate(parts), 6) if parts else np.zeros(0)
            ok = sims >= bound[i] - 5e-7
            i, j, sims = i[ok], j[ok], sims[ok]
        if len(i):
            self.waiting.append((i, other.ids[j], sims))
        # Until then the bound stays as it was, which costs less than a merge for every block.
        if sum(len(w[0]) for w in self.waiting) >= len(self.ids):
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            self.take(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
            self.waiting = []

    def take(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        touched = np.unique(rows)
        rows, ids, sims = (np.concatenate(x) for x in ((np.repeat(touched, self.k), rows), (self.found[touched].ravel(), ids), (self.sims[touched].ravel(), sims)))
        order = np.lexsort((ids, -sims, rows))
        rows, ids, sims = rows[order], ids[order], sims[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < self.k
        self.found[rows[best], rank[best]], self.sims[rows[best], rank[best]] = ids[best], sims[best]

    def result(self) -> pa.RecordBatch:
        self.merge()
        i, r = np.nonzero(self.sims > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.found[i, r]), pa.array(self.sims[i, r])], names=["src", "dst", "similarity"])


def _nearest(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Nearest] = []
        # Kept, as memory for every block anew would be cleared by the system each time.
        scratch = np.empty(BLOCK * BLOCK, np.float32), np.empty(-(-BLOCK * BLOCK // 8) * 8, bool)
        for batch in batches:
            for side, part in split(batch, BLOCK):
                if side == 0:
                    held.append(_Nearest(part, k, least))
                    continue
                other = _Vectors(part)
                for x in held:
                    x.meet(other, scratch)
        for x in held:
            yield x.result()

    return run


def similar_topk(vectors: DataFrame, k: int = 8, least: float = 0.25, asked: DataFrame | None = None) -> DataFrame:
    """(src, dst, similarity): each vector's ``k`` nearest of other labels, of at least ``least``; a table that is written.

    With ``asked``, rows of the same columns, only these are asked for theirs.  Rows
    without an id or a label are left out.

    All pairs are looked at.  A task holds a tile of bounded size with the bests of its
    rows so far and streams a part of all vectors past it, so that only ``k`` rows for
    each vector and part leave it, and each vector is sent to as many tasks as there
    are tiles and parts, not pairs of blocks.
    """
    bound_batches(vectors.sparkSession, rows=BLOCK)
    real = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    of = lambda df: cut(df.filter("embedding is not null and vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<float>" if real else "array<double>")), "vectors")
    right = of(vectors)
    left = right if asked is None else of(asked)
    (n, d), n_left = right.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first(), left.count()
    blocks = lambda rows, size: max(1, -(-rows // size))
    tiles = max(blocks(n_left, max(1, TILE_BYTES // (12 * max(1, d)))), min(TILES, blocks(n_left, BLOCK)))
    parts = min(blocks(n, BLOCK), max(PARTS, LANES // tiles))
    dealt = lambda rows, among: rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(among)).cast("int"))
    met = meet(dealt(left, tiles), dealt(right, parts), [(t, p) for t in range(tiles) for p in range(parts)], ["vec_id"])
    found = met.mapInArrow(_nearest(k, least), "src long, dst long, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return cut(found.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("similarity") >= least)).select("src", "dst", "similarity"), "similar")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is there too."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi")


def minmax(values: DataFrame, columns: list[str]) -> DataFrame:
    """Each signal scaled to 0..1 over all rows; a flat one is 1 where positive, else 0."""
    bounds = values.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = values.join(F.broadcast(bounds))
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        out = out.withColumn(c, F.when(hi - lo < 1e-12, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.select(*values.columns)


#: Default weights of the signals and the offset of reciprocal ranks.
WEIGHTS = {"bm25": 0.20, "vector": 0.60, "entity": 0.10, "ngram": 0.10}
RRF_OFFSET = 60


def weighted(values: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows with ``fused``: the weighted sum of min-max scaled signals."""
    weights = weights or WEIGHTS
    fused = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return minmax(values, list(weights)).withColumn("fused", fused)


def reciprocal_rank(values: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Rows with ``fused``: summed reciprocal ranks over the signals that are positive.

    The candidate pool is bounded by its arms, so one window over it is too.
    """
    fused = F.lit(0.0)
    for c in columns:
        rank = F.row_number().over(Window.orderBy(F.desc(c), id_col))
        fused = fused + F.when(F.col(c) > 0, 1.0 / (RRF_OFFSET + rank)).otherwise(0.0)
    return values.withColumn("fused", fused)


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """R@1, R@5 and mean reciprocal rank, for all and by difficulty, of (query_id, result_rank, relevant, hard)."""
    best = ranked.groupBy("query_id", "hard").agg(F.min(F.when(F.col("relevant"), F.col("result_rank"))).alias("first"))
    rows = best.withColumn("split", F.explode(F.array(F.lit("all"), F.when(F.col("hard"), "hard").otherwise("easy"))))
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_queries"), at(1).alias("r_at_1"), at(5).alias("r_at_5"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
