"""Queries of the retrieval engine over the tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import conversation as C
from ..operators import dedup as D
from ..operators import entities as E
from ..operators import graph as G
from ..operators import index as K
from ..operators import ingest as N
from ..operators import maintain as M
from ..operators import retrieval as R
from ..operators import enrich as Z
from ..operators import search as S
from ..operators import sessions as O
from ..plans.lineage import cut, shared_root
from ..sources.tables import line_chunks, messages, sources, spread, table
from ..streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` for queries whose cost is in their text functions."""
    return spread(docs(spark, d))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The query text of the search queries: the first benchmark item."""
    return table(spark, d, "benchmark").orderBy("item_id").limit(1).select("text")


def asked_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1)


# ---- SQL that several queries share ----

_TEXT = "coalesce(text, '')"

_CHUNKS = r"""
lines AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS text,
  generate_subscripts(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1) AS ord FROM documents)
"""


def _terms(table_: str, id_: str, name: str = "terms") -> str:
    return rf"""
{name}_w AS (SELECT {id_}, unnest(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}_./-]*'), lambda w: lower(regexp_replace(w, '^[._/-]+|[._/-]+$', '', 'g'))), lambda w: w <> '' AND strlen(w) <= 64)) AS word FROM {table_}),
{name} AS (SELECT {id_}, word AS term FROM {name}_w UNION ALL
  SELECT {id_}, p FROM (SELECT {id_}, unnest(string_split_regex(word, '[._/-]')) AS p FROM {name}_w WHERE regexp_matches(word, '[._/-]')) WHERE strlen(p) >= 2)
"""


def _tokens(text: str) -> str:
    return rf"CAST(coalesce(list_sum(list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}\s]'), lambda w: CASE WHEN strlen(w) > 6 THEN 1 + (strlen(w) - 3) // 4 ELSE 1 END)), 0) AS BIGINT)"


_STARTERS = ", ".join(f"'{w}'" for w in X.STARTERS)
_FENCE = r"(?m)^[^\S\n]*(?:`{3,}[^`\n]*|~{3,}[^\n]*)$"


def _entities(rows: str, id_: str, prefix: str = "") -> str:
    """CTEs ``ents`` (id, kind, value, count) of a table's texts; code is taken out first."""
    p = prefix
    return rf"""
{p}outside AS (SELECT {id_}, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '{_FENCE}'), lambda x, i: i % 2 = 1), chr(10)) AS text FROM {rows}),
{p}clean AS (SELECT {id_}, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, '`'), lambda x, i: CASE WHEN i % 2 = 0 THEN repeat(' ', length(x)) ELSE x END), ' ')), chr(10)) AS text FROM {p}outside),
{p}proper AS (SELECT {id_}, regexp_replace(v, '^(?:The|A|An) [ \t]*', '') AS v FROM (SELECT {id_}, unnest(regexp_extract_all(text, '\b(\p{{Lu}}[\p{{L}}0-9]*(?:[ \t]+\p{{Lu}}[\p{{L}}0-9]*)*)\b', 1)) AS v FROM {p}clean)),
{p}raw AS (
  SELECT {id_}, 'date' AS kind, unnest(regexp_extract_all(text, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1)) AS v FROM {p}clean UNION ALL
  SELECT {id_}, 'date', unnest(regexp_extract_all(text, '\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}})\b', 1)) FROM {p}clean UNION ALL
  SELECT {id_}, 'path', unnest(regexp_extract_all(text, '\b([\w.-]+/[\w./-]+|\w+\.(?:go|js|ts|md|py|json|yaml|yml|sql|sh|html|css|txt))\b', 1)) FROM {p}clean UNION ALL
  SELECT {id_}, 'number', unnest(regexp_extract_all(text, '([$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:%|ms|s|kb|mb|gb|tb|px|em|rem)\b)', 1)) FROM {p}clean UNION ALL
  SELECT {id_}, 'proper', v FROM {p}proper WHERE v <> '' AND NOT (NOT contains(v, ' ') AND lower(v) IN ({_STARTERS})) AND NOT (strlen(v) < 3 AND v = upper(v)) AND strlen(v) <= 128),
{p}ents AS (SELECT {id_}, kind, lower(trim(v)) AS value, count(*) AS count FROM {p}raw WHERE strlen(trim(v)) BETWEEN 1 AND 128 GROUP BY ALL)
"""


_ENTITIES = _entities("documents", "doc_id")
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SIMILAR = f"""
sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({_COS.format(a="a.embedding", b="b.embedding")}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label <> b.label),
similar_ AS (SELECT src, dst, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS r FROM sims) WHERE r <= 8 AND similarity >= 0.25)
"""
_MESSAGES = "m AS (SELECT conv_id AS session_id, turn + 1 AS seq, role, coalesce(text, '') AS content FROM conversations)"
_TURNS = rf"""
{_MESSAGES},
n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS turn_no FROM m),
t AS (SELECT session_id, turn_no, max(seq) FILTER (role = 'user') AS start_seq, max(content) FILTER (role = 'user') AS user_text,
  min(seq) FILTER (role = 'assistant' AND content <> '') AS reply_at, arg_min(content, seq) FILTER (role = 'assistant' AND content <> '') AS reply FROM n WHERE turn_no > 0 GROUP BY ALL),
s AS (SELECT *, CASE WHEN trim(user_text) = '' OR coalesce(trim(reply), '') = '' THEN 'no reply' WHEN strlen(user_text) + coalesce(strlen(reply), 0) > 200000 THEN 'too long' END AS skip_reason FROM t)
"""

# ---- chunks, terms, BM25 ----


@query("line_chunks", f"WITH {_CHUNKS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, text FROM lines")
def _(spark, d):
    return line_chunks(docs(spark, d))


@query("seq_edges", f"WITH {_CHUNKS}, p AS (SELECT a.doc_id, a.ord AS x, b.ord AS y FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1) SELECT doc_id, CAST(x AS BIGINT) AS src_ord, CAST(y AS BIGINT) AS dst_ord, 'next' AS kind, CAST(1.0 AS DOUBLE) AS weight FROM p UNION ALL SELECT doc_id, CAST(y AS BIGINT), CAST(x AS BIGINT), 'prev', CAST(1.0 AS DOUBLE) FROM p")
def _(spark, d):
    return G.sequence_edges(line_chunks(docs(spark, d)))


@query("term_freq", f"WITH {_terms('documents', 'doc_id')} SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL")
def _(spark, d):
    return R.term_freq(texts(spark, d))


@query("term_df", f"WITH {_terms('documents', 'doc_id')} SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY ALL")
def _(spark, d):
    return R.term_df(R.term_freq(texts(spark, d)))


@query("token_count", f"SELECT doc_id, {_tokens(_TEXT)} AS token_count FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.token_count(F.coalesce("text", F.lit(""))).alias("token_count"))


_STATS = f"n AS (SELECT doc_id, {_tokens(_TEXT)} AS n FROM documents), stats AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, greatest(avg(n), 1.0) AS avg_tokens FROM n)"


@query("corpus_stats", f"WITH {_STATS} SELECT n_docs, n_tokens, round(avg_tokens, 6) AS avg_tokens FROM stats")
def _(spark, d):
    return R.corpus_stats(texts(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6))


_ASKED = "q AS (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1)"
_BM25 = f"""
{_ASKED}, {_terms("q", "item_id", "wanted")}, {_terms("documents", "doc_id")}, {_STATS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
probes AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY df, term LIMIT 12),
scores AS (SELECT tf.doc_id, round(sum(greatest(0.0, ln(1 + (n_docs - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * greatest(n.n, 1) / avg_tokens))), 6) AS score
  FROM tf JOIN probes USING (term) JOIN n ON n.doc_id = tf.doc_id CROSS JOIN stats GROUP BY tf.doc_id)
"""


@query("rare_probe", f"WITH {_BM25} SELECT term, df FROM probes")
def _(spark, d):
    return R.rare_probe(asked(spark, d), R.term_df(R.term_freq(texts(spark, d))))


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 20")
def _(spark, d):
    return R.bm25(texts(spark, d), asked(spark, d)).withColumn("score", F.round("score", 6))


# ---- vectors ----

@query("bm25_all", f"""WITH {_terms("benchmark", "item_id", "wanted")}, {_terms("documents", "doc_id")}, {_STATS},
w AS (SELECT DISTINCT item_id, term FROM wanted), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), probes AS (SELECT item_id, term, df FROM w JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, term) <= 12),
scores AS (SELECT item_id, tf.doc_id, round(sum(greatest(0.0, ln(1 + (n_docs - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * greatest(n.n, 1) / avg_tokens))), 6) AS score
  FROM tf JOIN probes USING (term) JOIN n ON n.doc_id = tf.doc_id CROSS JOIN stats GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10""")
def _(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_many(texts(spark, d), queries, 10).withColumnRenamed("query_id", "item_id").withColumn("rank", F.col("rank").cast("long"))


_KNN = f"knn AS (SELECT e.vec_id, e.label, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)"


@query("knn_topk", f"WITH {_KNN} SELECT * FROM knn ORDER BY similarity DESC, vec_id LIMIT 10")
def _(spark, d):
    return R.knn(table(spark, d, "embeddings"), asked_vector(spark, d), 10).withColumn("similarity", F.round("similarity", 6))


@query("knn_ids", f"WITH {_KNN} SELECT vec_id FROM knn ORDER BY similarity DESC, vec_id LIMIT 200")
def _(spark, d):
    return R.knn(table(spark, d, "embeddings"), asked_vector(spark, d), 200).select("vec_id")


@query("similar_topk", f"WITH {_SIMILAR} SELECT * FROM similar_")
def _(spark, d):
    return R.similar_topk(table(spark, d, "embeddings"))


@query("similar_mutual", f"WITH {_SIMILAR} SELECT a.src, a.dst, a.similarity FROM similar_ a JOIN similar_ b ON a.src = b.dst AND a.dst = b.src")
def _(spark, d):
    return R.mutual(R.similar_topk(table(spark, d, "embeddings")))


# ---- copies ----


@query("content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def _(spark, d):
    return D.content_hash(docs(spark, d))


@query("exact_dups", "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return D.exact_copies(docs(spark, d))


@query("dedup_rare_terms", f"WITH {_terms('documents', 'doc_id')}, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE strlen(term) >= 4 GROUP BY ALL) SELECT doc_id, term, tf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf, term) AS rank FROM tf) WHERE rank <= 6")
def _(spark, d):
    return D.rare_terms(texts(spark, d))


@query("dice_pairs")
def _(spark, d):
    return D.near_pairs(texts(spark, d)).withColumn("dice", F.round("dice", 6))


# ---- entities ----


@query("entity_counts", f"WITH {_ENTITIES} SELECT doc_id, kind, value, count FROM ents")
def _(spark, d):
    return E.entity_counts(texts(spark, d))


@query("entity_proper", f"WITH {_ENTITIES} SELECT value, count(*) AS df, CAST(sum(count) AS BIGINT) AS uses FROM ents WHERE kind = 'proper' GROUP BY value")
def _(spark, d):
    return E.entity_counts(texts(spark, d)).filter("kind = 'proper'").groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.sum("count").alias("uses"))


_RARE = f"{_ENTITIES}, rare AS (SELECT kind, value, count(DISTINCT doc_id) AS df FROM ents GROUP BY kind, value HAVING count(DISTINCT doc_id) BETWEEN 2 AND 12)"


@query("rare_entities", f"WITH {_RARE} SELECT kind, value, df FROM rare")
def _(spark, d):
    return E.rare_entities(E.entity_counts(texts(spark, d)))


@query("entity_edges", f"""WITH {_RARE}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
r AS (SELECT e.doc_id, d.source, kind, value, df FROM ents e JOIN rare USING (kind, value) JOIN documents d ON d.doc_id = e.doc_id),
p AS (SELECT a.doc_id AS src, b.doc_id AS dst, round(max(least(1.0, ln(n / a.df) / ln(n))), 6) AS weight FROM r a JOIN r b ON a.kind = b.kind AND a.value = b.value AND a.source <> b.source CROSS JOIN n GROUP BY ALL)
SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM p WHERE weight > 0) WHERE rank <= 12""")
def _(spark, d):
    rows = texts(spark, d)
    links = E.entity_counts(rows).join(rows.select("doc_id", "source"), "doc_id")
    return E.entity_edges(links, rows.agg(F.count(F.lit(1)).alias("n")), source_col="source")


_GRAMS = r"""w AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[.,;:!?"''()\[\]{}]+|[.,;:!?"''()\[\]{}]+$', '', 'g')), lambda x: x <> '') AS w FROM QUERY),
grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS gram FROM w, range(1, 5) a(n), range(1, 2000) b(i) WHERE i + n - 1 <= len(w))"""


@query("query_ngrams", f"WITH {_GRAMS.replace('QUERY', 'benchmark')} SELECT item_id, gram FROM grams")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.query_ngrams(F.col("text"))).alias("gram"))


_JACCARD = f"""{_ENTITIES}, {_ASKED}, {_GRAMS.replace("QUERY", "q")}, {_entities("q", "item_id", "q_")}, named AS (SELECT value FROM ents WHERE value IN (SELECT gram FROM grams) UNION SELECT value FROM q_ents), ev AS (SELECT DISTINCT doc_id, value FROM ents),
sz AS (SELECT doc_id, count(*) AS n FROM ev GROUP BY ALL), sh AS (SELECT doc_id, count(*) AS shared FROM ev WHERE value IN (SELECT value FROM named) GROUP BY ALL),
jac AS (SELECT doc_id, round(shared / (n + (SELECT count(*) FROM named) - shared), 6) AS jaccard FROM sh JOIN sz USING (doc_id))"""


@query("entity_jaccard", f"WITH {_JACCARD} SELECT doc_id, jaccard FROM jac")
def _(spark, d):
    links = cut(E.entity_counts(texts(spark, d)), "links")
    return E.entity_jaccard(links, E.query_entities(asked(spark, d), E.dictionary(links))).withColumn("jaccard", F.round("jaccard", 6))


# ---- fusion and search ----


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _folded(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"


def _trigrams(x: str) -> str:
    return f"CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3))) WHEN length({x}) > 0 THEN [{x}] ELSE [] END"


_POOL = f"""
{_BM25}, {_JACCARD.replace(_ASKED + ",", "")}, {_KNN},
arm_b AS (SELECT doc_id, score AS bm25 FROM scores ORDER BY score DESC, doc_id LIMIT 200),
arm_v AS (SELECT vec_id AS doc_id, similarity AS vector FROM knn ORDER BY similarity DESC, vec_id LIMIT 200),
arm_e AS (SELECT doc_id FROM jac ORDER BY doc_id LIMIT 100),
ids AS (SELECT doc_id FROM arm_b UNION SELECT doc_id FROM arm_v UNION SELECT doc_id FROM arm_e),
fold AS MATERIALIZED (SELECT doc_id, source, {_folded(_TEXT)} AS x FROM documents d WHERE doc_id IN (SELECT doc_id FROM ids)),
gr AS MATERIALIZED (SELECT doc_id, source, {_trigrams("x")} AS g FROM fold),
qf AS MATERIALIZED (SELECT {_folded("text")} AS x FROM q), qg AS MATERIALIZED (SELECT {_trigrams("x")} AS h FROM qf),
pool AS (SELECT doc_id, source, coalesce(bm25, 0.0) AS bm25, coalesce(vector, 0.0) AS vector, coalesce(jaccard, 0.0) AS entity, round({_dice("g", "h")}, 6) AS ngram
  FROM gr CROSS JOIN qg LEFT JOIN arm_b USING (doc_id) LEFT JOIN arm_v USING (doc_id) LEFT JOIN jac USING (doc_id))
"""
_SCALED = ", ".join(f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-12 THEN CASE WHEN max({c}) OVER () > 0 THEN 1.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS {c}" for c in S.SIGNALS)
_FUSED = f"{_POOL}, scaled AS (SELECT doc_id, source, {_SCALED} FROM pool), fused AS (SELECT doc_id, source, round(0.20 * bm25 + 0.60 * vector + 0.10 * entity + 0.10 * ngram, 6) AS fused FROM scaled)"


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return S.candidates(texts(spark, d), table(spark, d, "embeddings"), asked(spark, d), asked_vector(spark, d))


@query("minmax_fusion", f"WITH {_FUSED} SELECT doc_id, fused FROM fused")
def _(spark, d):
    return S.fuse(_pool(spark, d), S.Options()).select("doc_id", F.round("fused", 6).alias("fused"))


_RRF = " + ".join(f"CASE WHEN {c} > 0 THEN 1.0 / (60 + row_number() OVER (ORDER BY {c} DESC, doc_id)) ELSE 0.0 END" for c in S.SIGNALS)


@query("rrf_fusion", f"WITH {_POOL} SELECT doc_id, round({_RRF}, 6) AS fused FROM pool")
def _(spark, d):
    return S.fuse(_pool(spark, d), S.Options(mode="rrf")).select("doc_id", F.round("fused", 6).alias("fused"))


@query("best_per_source", f"WITH {_FUSED} SELECT source, doc_id, fused FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fused DESC, doc_id) AS r FROM fused) WHERE r = 1")
def _(spark, d):
    return S.best_per_source(S.fuse(_pool(spark, d), S.Options())).withColumn("fused", F.round("fused", 6))


def index_of(spark: SparkSession, d: str) -> K.Index:
    """The index of the documents of a folder, made once for a session and folder."""
    if (spark.sparkContext.applicationId, d) not in _INDEXES:
        _INDEXES[spark.sparkContext.applicationId, d] = K.build(texts(spark, d).select("doc_id", "text", "source"), f"{shared_root(spark)}/index-{uuid.uuid4().hex}", parts=8)
    return _INDEXES[spark.sparkContext.applicationId, d]


_INDEXES: dict[tuple[str, str], K.Index] = {}


@query("bm25_indexed", f"WITH {_BM25} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 20")
def _(spark, d):
    return K.bm25(index_of(spark, d), asked(spark, d)).withColumn("score", F.round("score", 6))


@query("entity_jaccard_indexed", f"WITH {_JACCARD} SELECT doc_id, jaccard FROM jac")
def _(spark, d):
    return K.entity_signal(index_of(spark, d), asked(spark, d)).withColumnRenamed("entity", "jaccard")


@query("minmax_fusion_indexed", f"WITH {_FUSED} SELECT doc_id, fused FROM fused")
def _(spark, d):
    pool = S.candidates(docs(spark, d), table(spark, d, "embeddings"), asked(spark, d), asked_vector(spark, d), index_of(spark, d))
    return S.fuse(pool, S.Options()).select("doc_id", F.round("fused", 6).alias("fused"))


@query("fused_search_indexed")
def _(spark, d):
    return S.search(docs(spark, d), table(spark, d, "embeddings"), asked(spark, d), asked_vector(spark, d), index=index_of(spark, d))


@query("fused_search")
def _(spark, d):
    return S.search(texts(spark, d), table(spark, d, "embeddings"), asked(spark, d), asked_vector(spark, d))


@query("fused_search_walk")
def _(spark, d):
    edges = R.mutual(R.similar_topk(table(spark, d, "embeddings"))).select("src", "dst", F.lit("similar").alias("kind"), F.col("similarity").alias("weight"))
    return S.search(texts(spark, d), table(spark, d, "embeddings"), asked(spark, d), asked_vector(spark, d), edges)


@query("walk_2hop", f"""WITH {_SIMILAR}, {_KNN},
e AS (SELECT a.src, a.dst, a.similarity * 0.4 AS gain FROM similar_ a JOIN similar_ b ON a.src = b.dst AND a.dst = b.src),
seeds AS (SELECT vec_id AS node, similarity AS score FROM knn ORDER BY similarity DESC, vec_id LIMIT 10),
h1 AS (SELECT dst AS node, max(score * gain) AS score FROM e JOIN seeds ON src = node WHERE score * gain >= 1e-4 AND dst NOT IN (SELECT node FROM seeds) GROUP BY dst ORDER BY score DESC, node LIMIT 30),
h2 AS (SELECT dst AS node, max(score * gain) AS score FROM e JOIN h1 ON src = node WHERE score * gain >= 1e-4 AND dst NOT IN (SELECT node FROM seeds) AND dst NOT IN (SELECT node FROM h1) GROUP BY dst ORDER BY score DESC, node LIMIT 30)
SELECT node, round(score, 9) AS score, 1 AS hops FROM h1 UNION ALL SELECT node, round(score, 9), 2 FROM h2""")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    edges = R.mutual(R.similar_topk(vectors)).select("src", "dst", F.lit("similar").alias("kind"), F.col("similarity").alias("weight"))
    seeds = R.knn(vectors, asked_vector(spark, d), 10).select(F.col("vec_id").alias("node"), F.round("similarity", 6).alias("score"))
    return G.walk(edges, seeds).drop("via").withColumn("score", F.round("score", 9))


# ---- conversations ----


@query("turn_pairs", f"WITH {_TURNS}, ok AS (SELECT * FROM s WHERE skip_reason IS NULL) SELECT session_id, start_seq, reply_at AS end_seq, session_id || '#' || start_seq || '-' || reply_at AS ref, 'User: ' || regexp_replace(user_text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Assistant: ' || regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS turn_text FROM ok")
def _(spark, d):
    return C.turn_pairs(messages(table(spark, d, "conversations"))).select("session_id", "start_seq", "end_seq", "ref", "turn_text")


@query("turn_skips", f"WITH {_TURNS} SELECT session_id, start_seq, skip_reason FROM s WHERE skip_reason IS NOT NULL")
def _(spark, d):
    return C.turns(messages(table(spark, d, "conversations"))).filter("skip_reason is not null").select("session_id", "start_seq", "skip_reason")


@query("thread_context", f"""WITH {_TURNS}, ok AS (SELECT session_id, start_seq, array_to_string(list_filter(string_split_regex(user_text, '\\s+'), lambda w: w <> '')[1:12], ' ') AS gist FROM s WHERE skip_reason IS NULL),
g AS (SELECT *, lag(gist) OVER (PARTITION BY session_id ORDER BY start_seq) AS prev FROM ok)
SELECT session_id, start_seq, 'Conversation: session ' || session_id || CASE WHEN coalesce(prev, '') <> '' THEN ' — Previously: ' || prev ELSE '' END AS context FROM g""")
def _(spark, d):
    pairs = C.turn_pairs(messages(table(spark, d, "conversations")))
    title = F.concat(F.lit("session "), F.col("session_id").cast("string"))
    return pairs.select("session_id", "start_seq", C.thread_context(title, F.col("prev_gist")).alias("context"))


@query("session_list", f"WITH {_MESSAGES} SELECT session_id, count(*) FILTER (role IN ('user', 'assistant')) AS message_count, max(seq) AS last_seq FROM m GROUP BY ALL")
def _(spark, d):
    return C.session_list(messages(table(spark, d, "conversations")))


@query("next_seq", f"WITH {_MESSAGES}, ss AS (SELECT DISTINCT session_id FROM m UNION SELECT -5) SELECT ss.session_id, coalesce(max(seq), 0) + 1 AS next_seq FROM ss LEFT JOIN m ON m.session_id = ss.session_id GROUP BY ss.session_id")
def _(spark, d):
    m = messages(table(spark, d, "conversations"))
    known = m.select("session_id").unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("session_id")))
    return C.next_seq(m, known)


@query("pinned_history", f"WITH {_MESSAGES} SELECT session_id, seq, role, content FROM m WHERE role IN ('user', 'assistant') AND seq % 2 = 1")
def _(spark, d):
    pinned = messages(table(spark, d, "conversations")).withColumn("pinned", F.col("seq") % 2 == 1)
    return pinned.filter(F.col("pinned") & F.col("role").isin("user", "assistant")).select("session_id", "seq", "role", "content")


@query("context_tokens", f"WITH {_MESSAGES} SELECT session_id, CAST(sum(ceil(length(content) / 4) + 8) AS BIGINT) AS tokens FROM m WHERE role IN ('user', 'assistant') GROUP BY ALL")
def _(spark, d):
    return C.context_tokens(messages(table(spark, d, "conversations")))


@query("unindexed_sessions", "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, d):
    known = docs(spark, d).filter("lang = 'en'").select(F.col("doc_id").alias("session_id"))
    return messages(table(spark, d, "conversations")).select("session_id").distinct().join(known, "session_id", "left_anti")


# ---- status, maintenance ----

_SOURCES = f"src AS (SELECT doc_id AS source_id, source || '/' || doc_id || '.md' AS source_ref, source AS folder, sha256(coalesce(text, '')) AS content_hash, {_tokens(_TEXT)} AS token_count, CAST(strlen(coalesce(text, '')) AS BIGINT) AS file_size FROM documents)"


@query("sources", f"WITH {_SOURCES} SELECT * FROM src")
def _(spark, d):
    return sources(docs(spark, d))


@query("folder_rollup", f"WITH {_SOURCES} SELECT folder, count(*) AS notes, CAST(sum(token_count) AS BIGINT) AS tokens FROM src GROUP BY ALL")
def _(spark, d):
    return M.folder_rollup(sources(docs(spark, d)))


def note_links(spark: SparkSession, d: str) -> DataFrame:
    """Links among the documents as notes (from_ref, to_ref): each names up to four others, one of them twice."""
    ref = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    rows = docs(spark, d).select("doc_id", ref.alias("ref"))
    wanted = F.concat(F.sequence(F.lit(0), F.col("doc_id") % 5), F.array(F.lit(1))).cast("array<bigint>")
    out = rows.select(F.col("ref").alias("from_ref"), F.posexplode(wanted).alias("pos", "k"), "doc_id").withColumn("to_id", F.col("doc_id") + F.col("k") * 3)
    return out.join(rows.select(F.col("doc_id").alias("to_id"), F.col("ref").alias("to_ref")), "to_id").select("from_ref", "to_ref", "pos")


LINKS_SQL = "refs AS (SELECT doc_id, source || '/' || doc_id || '.md' AS ref FROM documents), note_links AS (SELECT a.ref AS from_ref, b.ref AS to_ref, i - 1 AS pos FROM (SELECT doc_id, ref, unnest(list_append(range(0, doc_id % 5 + 1), 1)) AS k, generate_subscripts(list_append(range(0, doc_id % 5 + 1), 1), 1) AS i FROM refs) a JOIN refs b ON b.doc_id = a.doc_id + a.k * 3)"


@query("enrich_priority", f"WITH {_SOURCES}, {LINKS_SQL}, l AS (SELECT from_ref, count(DISTINCT to_ref) AS n_links FROM note_links GROUP BY ALL) SELECT source_id, coalesce(n_links, 0) AS n_links, token_count FROM src LEFT JOIN l ON l.from_ref = source_ref WHERE source_id % 3 <> 0 ORDER BY n_links DESC, token_count DESC, source_ref LIMIT 25")
def _(spark, d):
    state = F.when(F.col("source_id") % 3 == 0, "done").otherwise("pending")
    s = sources(docs(spark, d)).withColumn("entity_pass", state).withColumn("ingested_at", F.lit("2024-01-01"))
    return Z.pending(s, note_links(spark, d)).select("source_id", "n_links", "token_count")


@query("status_counts", f"WITH {_SIMILAR} SELECT 'similar' AS kind, count(*) AS edges FROM similar_ UNION ALL SELECT 'role:' || role, count(*) FROM conversations GROUP BY role")
def _(spark, d):
    similar = R.similar_topk(table(spark, d, "embeddings")).select(F.lit("similar").alias("kind"))
    roles = table(spark, d, "conversations").select(F.concat(F.lit("role:"), "role").alias("kind"))
    return similar.unionByName(roles).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@query("stats_row", f"WITH {_terms('documents', 'doc_id')} SELECT (SELECT count(*) FROM documents) AS sources, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS vectors, (SELECT count(DISTINCT term) FROM terms) AS terms, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM pages) AS artifacts")
def _(spark, d):
    one = lambda df, name, what=None: df.agg((F.count(F.lit(1)) if what is None else F.count_distinct(what)).alias(name))
    parts = [one(docs(spark, d), "sources"), one(table(spark, d, "embeddings").filter("embedding is not null"), "vectors"), R.term_df(R.term_freq(texts(spark, d))).agg(F.count(F.lit(1)).alias("terms")), one(table(spark, d, "conversations"), "sessions", F.col("conv_id")), one(table(spark, d, "pages"), "artifacts")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@query("orphan_sweep", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def _(spark, d):
    return M.sweep_orphans(table(spark, d, "labels"), docs(spark, d).filter("lang <> 'en'"), "doc_id").select("doc_id", "quality", "toxic")


@query("cascade_delete", f"WITH {_terms('documents', 'doc_id')} SELECT term, count(DISTINCT doc_id) AS df FROM terms WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0') GROUP BY ALL")
def _(spark, d):
    rows = docs(spark, d)
    chunks = rows.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("chunk_id"))
    edges = chunks.select(F.col("chunk_id").alias("src"), (F.col("chunk_id") + 1).alias("dst"))
    gone = rows.filter("source = 'src0'").select(F.col("doc_id").alias("source_id"))
    return M.cascade(gone, chunks, R.term_freq(rows).withColumnRenamed("doc_id", "chunk_id"), edges)["terms"]


@query("cascade_edges", "WITH k AS (SELECT doc_id FROM documents WHERE source <> 'src0') SELECT doc_id AS src, doc_id + 1 AS dst FROM k WHERE doc_id + 1 IN (SELECT doc_id FROM k)")
def _(spark, d):
    rows = docs(spark, d)
    chunks = rows.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("chunk_id"))
    edges = chunks.select(F.col("chunk_id").alias("src"), (F.col("chunk_id") + 1).alias("dst"))
    gone = rows.filter("source = 'src0'").select(F.col("doc_id").alias("source_id"))
    return M.cascade(gone, chunks, chunks.select("chunk_id", F.lit("t").alias("term")), edges)["edges"].select("src", "dst")


@query("upsert_edges", f"WITH {_SIMILAR}, o AS (SELECT src, dst, 'similar' AS kind, similarity AS weight FROM similar_), nw AS (SELECT src, dst, kind, CAST(0.5 AS DOUBLE) AS weight FROM o WHERE src % 3 = 0) SELECT * FROM o WHERE src % 3 <> 0 UNION ALL SELECT * FROM nw")
def _(spark, d):
    old = R.similar_topk(table(spark, d, "embeddings")).select("src", "dst", F.lit("similar").alias("kind"), F.col("similarity").alias("weight"))
    return G.upsert_edges(old, old.filter("src % 3 = 0").withColumn("weight", F.lit(0.5)))


@query("insert_ignore", "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, -1, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    new = docs(spark, d).select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return M.insert_ignore(table(spark, d, "labels"), new, ["doc_id"])


@query("incremental_diff", """WITH k AS (SELECT doc_id AS ref, n_chars AS size, sha256(coalesce(text, '')) AS hash FROM documents),
p AS (SELECT doc_id AS ref, CASE WHEN doc_id % 5 = 1 THEN n_chars + 1 ELSE n_chars END AS size, doc_id % 5 = 2 AS later, CASE WHEN doc_id % 5 IN (1, 3) THEN 'x' ELSE sha256(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -1, 1, false, 'n')
SELECT coalesce(k.ref, p.ref) AS ref, CASE WHEN k.ref IS NULL THEN 'added' WHEN p.ref IS NULL THEN 'removed' WHEN p.size = k.size AND NOT later THEN 'unchanged' WHEN p.hash = k.hash THEN 'touched' ELSE 'changed' END AS action FROM k FULL OUTER JOIN p ON k.ref = p.ref""")
def _(spark, d):
    rows, r = docs(spark, d), F.col("doc_id")
    then, hash_ = F.expr("timestamp'2024-01-01 00:00:00'"), F.sha2(F.coalesce("text", F.lit("")), 256)
    known = rows.select(r.alias("ref"), F.col("n_chars").alias("size"), then.alias("mtime"), hash_.alias("hash"))
    now = rows.filter("doc_id % 7 <> 0").select(r.alias("ref"), F.when(r % 5 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.when(r % 5 == 2, then + F.expr("interval 1 minute")).otherwise(then + F.expr("interval 1 millisecond")).alias("mtime"), F.when((r % 5).isin(1, 3), "x").otherwise(hash_).alias("hash"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("ref"), F.lit(1).cast("long").alias("size"), then.alias("mtime"), F.lit("n").alias("hash"))
    return M.snapshot_diff(known, now.unionByName(new))


@query("source_filter", "SELECT doc_id, source FROM documents WHERE (source || '/' || doc_id) = 'src1' OR starts_with(source || '/' || doc_id, 'src1/')")
def _(spark, d):
    path = "concat(source, '/', cast(doc_id as string))"
    return docs(spark, d).filter(M.under_root(path, "'src1'")).select("doc_id", "source")


# ---- links, on fixtures ----

_NOTES = [("notes/Alpha.md", ["first", "A one"]), ("notes/Beta.md", []), ("archive/Beta.md", []), ("daily/2024-05-01.md", ["today"]), ("notes/deep/Gamma.md", [])]
_LINKS = [
    ("notes/Alpha.md", "Gamma", "Part", "[[Gamma#Part]]", False, "link", 1), ("notes/Alpha.md", "notes/Beta", "", "[[notes/Beta]]", False, "link", 2), ("notes/Alpha.md", "notes/Beta", "", "![[notes/Beta]]", True, "link", 3),
    ("notes/Beta.md", "first", "", "[[first]]", False, "link", 1), ("notes/Beta.md", "beta", "", "[[beta]]", False, "link", 2), ("daily/2024-05-01.md", "nowhere", "", "[[nowhere]]", False, "link", 1),
    ("notes/deep/Gamma.md", "A One", "", "[[A One|x]]", False, "link", 1), ("notes/deep/Gamma.md", "TODAY", "Missing", "[[TODAY#Missing]]", False, "link", 2), ("notes/deep/Gamma.md", "notes/Beta", "", "said to differ", False, "link_inferred", 3), ("daily/2024-05-01.md", "Alpha", "", "![[Alpha]]", True, "link", 2),
]
_CHUNK_ROWS = [("a1", "notes/Alpha.md", 1, "Intro", "Alpha"), ("a2", "notes/Alpha.md", 2, "see [[Gamma#Part]] and ![[notes/Beta]]", "Alpha › More"), ("a3", "notes/Alpha.md", 3, "again [[Gamma#Part]]", "Alpha › More"), ("b1", "notes/Beta.md", 1, "to [[first]] and [[beta]]", "Beta"), ("d1", "daily/2024-05-01.md", 1, "[[nowhere]]", ""), ("g1", "notes/deep/Gamma.md", 1, "top [[A One|x]]", "Gamma"), ("g2", "notes/deep/Gamma.md", 2, "[[TODAY#Missing]]", "Gamma › Part")]


def _values(rows: list[tuple]) -> str:
    lit = lambda v: str(v).lower() if isinstance(v, int) else "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_VAULT = rf"""notes(path, aliases) AS (VALUES {_values(_NOTES)}), links(from_ref, target, heading, raw, embed, kind, pos) AS (VALUES {_values(_LINKS)}),
k AS (SELECT path, regexp_replace(lower(trim(path)), '\.(md|markdown)$', '') AS key, aliases FROM notes),
al AS (SELECT regexp_replace(lower(trim(a)), '\.(md|markdown)$', '') AS want, min(path) AS p FROM (SELECT unnest(aliases) AS a, path FROM k) GROUP BY 1),
bs AS (SELECT regexp_extract(key, '([^/]+)$', 1) AS want, min(path) AS p FROM k GROUP BY 1 HAVING count(*) = 1),
res AS (SELECT l.*, coalesce(k.path, al.p, bs.p) AS to_ref, CASE WHEN k.path IS NOT NULL THEN 'path' WHEN al.p IS NOT NULL THEN 'alias' WHEN bs.p IS NOT NULL THEN 'basename' ELSE 'missing' END AS resolved_by
  FROM (SELECT *, regexp_replace(lower(trim(target)), '\.(md|markdown)$', '') AS want FROM links) l LEFT JOIN k ON k.key = l.want LEFT JOIN al ON al.want = l.want LEFT JOIN bs ON bs.want = l.want)"""
_VAULT_EDGES = rf"""{_VAULT}, ch(chunk_id, ref, ord, text, heading_path) AS (VALUES {_values(_CHUNK_ROWS)}),
lk AS (SELECT *, row_number() OVER () AS no FROM res WHERE to_ref IS NOT NULL),
hold AS (SELECT no, chunk_id AS src FROM lk JOIN ch ON ch.ref = from_ref WHERE contains(text, raw)),
s AS (SELECT * FROM hold UNION ALL SELECT no, arg_min(chunk_id, ord) FROM lk JOIN ch ON ch.ref = from_ref WHERE no NOT IN (SELECT no FROM hold) GROUP BY no),
mt AS (SELECT no, chunk_id, ord, CASE WHEN heading = '' THEN 3 WHEN lower(heading_path) = lower(heading) OR ends_with(lower(heading_path), ' › ' || lower(heading)) THEN 0 WHEN contains(lower(heading_path), lower(heading)) THEN 1 ELSE 3 END AS m FROM lk JOIN ch ON ch.ref = to_ref),
dd AS (SELECT no, arg_min(chunk_id, m * 1000 + ord) AS dst, min(m) AS m FROM mt GROUP BY no),
pl AS (SELECT src, dst, kind, CAST(CASE WHEN kind = 'link_inferred' THEN 0.8 WHEN m < 3 OR (heading = '' AND embed) THEN 1.0 ELSE 0.85 END AS DOUBLE) AS weight, from_ref, pos FROM lk JOIN s USING (no) JOIN dd USING (no) WHERE src <> dst),
le AS (SELECT src, dst, kind, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY from_ref, pos) AS r FROM pl) WHERE r = 1)"""
_LINK_COLUMNS = ["from_ref", "to_ref", "heading", "raw", "embed", "kind", "pos"]


def _resolved(spark: SparkSession) -> DataFrame:
    notes = spark.createDataFrame(_NOTES, "path string, aliases array<string>")
    return G.resolve_links(spark.createDataFrame(_LINKS, "from_ref string, target string, heading string, raw string, embed boolean, kind string, pos int"), notes)


def _link_edges(spark: SparkSession) -> DataFrame:
    chunks = spark.createDataFrame(_CHUNK_ROWS, "chunk_id string, ref string, ord int, text string, heading_path string")
    return G.link_edges(_resolved(spark).filter("to_ref is not null").select(*_LINK_COLUMNS), chunks)


@query("link_resolve", f"WITH {_VAULT} SELECT from_ref, target, heading, raw, to_ref, resolved_by FROM res")
def _(spark, d):
    return _resolved(spark).drop("embed", "kind", "pos")


@query("link_edges", f"WITH {_VAULT_EDGES} SELECT src, dst, kind, weight FROM le")
def _(spark, d):
    return _link_edges(spark)


@query("backlinks", f"WITH {_VAULT_EDGES} SELECT dst AS node, src AS linked_from, kind, weight FROM le")
def _(spark, d):
    return G.backlinks(_link_edges(spark))


@query("links_touching", f"WITH {_VAULT} SELECT from_ref, to_ref, heading, raw FROM res WHERE to_ref IS NOT NULL AND (from_ref = 'notes/Alpha.md' OR to_ref = 'notes/Alpha.md')")
def _(spark, d):
    refs = spark.createDataFrame([("notes/Alpha.md",)], "ref string")
    return M.touching(_resolved(spark).filter("to_ref is not null").select("from_ref", "to_ref", "heading", "raw"), refs).select("from_ref", "to_ref", "heading", "raw")


# ---- web, JSON ----

_PROSE = "strlen({0}) >= 80 AND NOT (starts_with({0}, 'http://') OR starts_with({0}, 'https://') OR starts_with({0}, '/') OR starts_with({0}, '{{') OR starts_with({0}, '[') OR starts_with({0}, '<')) AND NOT (contains({0}, 'data:') OR contains({0}, 'base64,')) AND NOT (strlen({0}) < 300 AND NOT contains({0}, ' '))"


@query("prose_filter", f"WITH {_CHUNKS} SELECT doc_id, CAST(ord AS BIGINT) AS ord FROM lines WHERE {_PROSE.format('text')}")
def _(spark, d):
    return line_chunks(docs(spark, d)).filter(X.is_prose(F.col("text"))).select("doc_id", "ord")


@query("word_gate")
def _(spark, d):
    return N.word_gate(spread(table(spark, d, "pages")))


@query("json_props", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


_STATED = "list_transform(range(0, doc_id % 4 + 1), lambda k: {'content': CASE WHEN (doc_id + k) % 3 = 1 THEN '' ELSE lang || k END, 'status': CASE WHEN k % 2 = 0 THEN 'done' END})"


@query("plan_steps_json", f"WITH j AS (SELECT doc_id, list_filter({_STATED}, lambda s: s.content <> '') AS steps FROM documents) SELECT doc_id, unnest(range(1, len(steps) + 1)) AS seq, unnest(list_transform(steps, lambda s: s.content)) AS content, unnest(list_transform(steps, lambda s: coalesce(s.status, 'pending'))) AS status FROM j")
def _(spark, d):
    k, step = F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4), "struct<content:string,status:string>"
    made = F.transform(k, lambda i: F.struct(F.when((F.col("doc_id") + i) % 3 == 1, "").otherwise(F.concat("lang", i.cast("string"))).alias("content"), F.when(i % 2 == 0, "done").alias("status")))
    plans = docs(spark, d).select("doc_id", F.from_json(F.to_json(F.struct(made.alias("steps"))), f"steps array<{step}>").alias("p"))
    steps = plans.select("doc_id", F.posexplode(F.filter("p.steps", lambda s: F.coalesce(s["content"], F.lit("")) != "")).alias("i", "s"))
    return steps.select("doc_id", (F.col("i") + 1).cast("long").alias("seq"), "s.content", F.coalesce("s.status", F.lit("pending")).alias("status"))


@query("json_suffix_key", "SELECT doc_id, lang || '.context_length' AS key, n_chars AS value FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    made = F.concat(F.lit('{"general.name":"x","'), "lang", F.lit('.context_length":"'), F.col("n_chars").cast("string"), F.lit('","'), "lang", F.lit('.block_count":"32"}'))
    info = F.from_json(made, "map<string,string>")
    hit = F.map_filter(info, lambda k, v: F.endswith(k, F.lit(".context_length")))
    return docs(spark, d).select("doc_id", F.explode(hit).alias("key", "value")).withColumn("value", F.col("value").cast("long"))


@query("gen_options", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"top_k":' || doc_id || '}' ELSE '{"temperature":0.5,"top_k":' || doc_id || '}' END AS options_json FROM documents""")
def _(spark, d):
    sparse = F.struct(F.when(F.col("doc_id") % 3 != 0, 0.5).alias("temperature"), F.col("doc_id").alias("top_k"))
    return docs(spark, d).select("doc_id", F.to_json(sparse).alias("options_json"))


# ---- evaluation, events ----

_QRELS = [(1, 1, True, False), (1, 2, False, False), (2, 3, True, True), (2, 1, False, True), (3, 7, True, False), (4, 1, False, True), (5, 2, True, False), (5, 5, True, False)]
_QREL_SQL = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in _QRELS)


@query("eval_metrics", f"""WITH q(query_id, result_rank, relevant, hard) AS (VALUES {_QREL_SQL}), b AS (SELECT query_id, hard, min(CASE WHEN relevant THEN result_rank END) AS f FROM q GROUP BY ALL), s AS (SELECT *, 'all' AS split FROM b UNION ALL SELECT *, CASE WHEN hard THEN 'hard' ELSE 'easy' END FROM b)
SELECT split, count(*) AS n_queries, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r_at_1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r_at_5, round(avg(coalesce(1.0 / f, 0.0)), 6) AS mrr FROM s GROUP BY split""")
def _(spark, d):
    out = R.retrieval_metrics(spark.createDataFrame(_QRELS, "query_id int, result_rank int, relevant boolean, hard boolean"))
    return out.select("split", "n_queries", *[F.round(c, 6).alias(c) for c in ("r_at_1", "r_at_5", "mrr")])


@query("ttl_latest", "WITH live AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM live GROUP BY user_id")
def _(spark, d):
    return I.ttl_latest(table(spark, d, "events"), "user_id", 7 * 24 * 60).select("user_id", "event_id", "event_type")


@query("failure_runs", """WITH e AS (SELECT *, CASE WHEN value < 50 THEN 1 ELSE 0 END AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, min(event_id) AS run_start, count(*) AS length FROM i WHERE bad = 1 GROUP BY user_id, island HAVING count(*) >= 3""")
def _(spark, d):
    return I.failure_runs(table(spark, d, "events"), "value < 50")


@query("labels_join", "SELECT d.lang, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def _(spark, d):
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("sessions_recent", "SELECT conv_id AS session_id, rank FROM (SELECT conv_id, CAST(row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS INTEGER) AS rank FROM conversations GROUP BY conv_id) WHERE rank <= 50")
def _(spark, d):
    top = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("t")).orderBy(F.desc("t"), "session_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("t"), "session_id"))).select("session_id", "rank")


# ---- parsing: rows only ----

_NOTE = """---
title: Plans
tags: [work, idea]
aliases:
  - Road map
---
# Plans

We will ship soon. Dr. Smith agreed! See [[Alpha#Part|the start]] and ![[Beta]].

```
# not a heading
```

## Costs #money

| item | cost |
|------|------|
| tea  | 3    |

- one #todo
- two
"""


def _notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, _NOTE), (2, ""), (3, None)], "doc_id long, text string")


QUERIES |= {
    "md_blocks": lambda spark, d: N.note_blocks(_notes(spark)),
    "frontmatter": lambda spark, d: N.note_front_matter(_notes(spark)),
    "note_links": lambda spark, d: N.note_links(_notes(spark)),
    "note_tags": lambda spark, d: N.note_tags(_notes(spark)),
    "sentences": lambda spark, d: N.sentence_rows(texts(spark, d)),
    "heading_chunks": lambda spark, d: N.note_chunks(texts(spark, d)),
    "leiden_chunks": lambda spark, d: N.note_chunks(texts(spark, d), "communities"),
    "hash_embed": lambda spark, d: N.text_vectors(texts(spark, d)),
    "visible_text": lambda spark, d: N.page_text(table(spark, d, "pages")),
    "article_md": lambda spark, d: N.page_articles(table(spark, d, "pages")),
    "script_partition": lambda spark, d: N.page_scripts(table(spark, d, "pages")),
    "page_state": lambda spark, d: N.page_state(table(spark, d, "pages")),
}


# ---- sessions and enrichment ----


@query("session_titles", r"WITH f AS (SELECT conv_id AS session_id, trim(regexp_replace(arg_min(coalesce(text, ''), turn), '\s+', ' ', 'g')) AS x FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT session_id, CASE WHEN x = '' THEN 'New Chat' WHEN length(x) > 40 THEN regexp_replace(substring(x, 1, 40), ' [^ ]*$', '') || '…' ELSE x END AS title FROM f")
def _(spark, d):
    first = messages(table(spark, d, "conversations")).filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", "seq").alias("content"))
    return first.select("session_id", O.title_of(F.col("content")).alias("title"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "in_progress", "pending", "odd")]), (F.least(F.col("seq"), F.col("session_id") % 6 + 1) % 4 + 1).cast("int"))
    return messages(table(spark, d, "conversations")).select("session_id", "seq", "content", status.alias("status"))


_PLANS = f"{_MESSAGES}, plan AS (SELECT session_id, seq, content, ['completed', 'in_progress', 'pending', 'odd'][least(seq, session_id % 6 + 1) % 4 + 1] AS status FROM m)"


@query("plan_faults", f"WITH {_PLANS}, f AS (SELECT session_id, CASE WHEN count(*) > 200 THEN 'too many steps' WHEN count(*) FILTER (status = 'odd') > 0 THEN 'unknown status' WHEN count(*) FILTER (trim(content) = '') > 0 THEN 'empty step' WHEN count(*) FILTER (status = 'in_progress') > 1 THEN 'several steps in progress' END AS fault FROM plan GROUP BY session_id) SELECT * FROM f WHERE fault IS NOT NULL")
def _(spark, d):
    return O.plan_faults(_plans(spark, d))


@query("plan_current", f"WITH {_PLANS} SELECT session_id, arg_min(seq, (CASE status WHEN 'in_progress' THEN 0 ELSE 1 END) * 100000 + seq) AS seq FROM plan WHERE status IN ('in_progress', 'pending') GROUP BY session_id")
def _(spark, d):
    return O.current_step(_plans(spark, d)).select("session_id", "seq")


_GUARD = """g AS (SELECT doc_id AS source_id, text, 'Proper' AS kind, split_part(coalesce(text, ''), ' ', 2) AS value FROM documents UNION ALL
  SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'strange' ELSE 'org' END, lang || ' ' || doc_id FROM documents),
r AS (SELECT source_id, kind, value, CASE WHEN trim(value) = '' THEN 'empty' WHEN strlen(trim(value)) > 96 THEN 'too long' WHEN lower(kind) = 'strange' THEN 'unknown kind' WHEN NOT contains(lower(text), lower(trim(value))) THEN 'not in the text' END AS reject_reason FROM g)"""


@query("entity_guard", f"WITH {_GUARD} SELECT source_id, kind, value, reject_reason FROM r")
def _(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    second = F.coalesce(F.try_element_at(F.split("text", " "), F.lit(2)), F.lit(""))
    made = rows.select("source_id", F.lit(0).alias("pos"), F.lit("Proper").alias("kind"), second.alias("value")).unionByName(
        rows.select("source_id", F.lit(1).alias("pos"), F.when(F.col("source_id") % 3 == 0, "strange").otherwise("org").alias("kind"), F.concat_ws(" ", "lang", F.col("source_id").cast("string")).alias("value"))
    )
    return Z.guard(made, rows).select("source_id", "kind", "value", "reject_reason")
