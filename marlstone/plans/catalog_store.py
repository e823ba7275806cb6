"""Queries that change a memory store made of the tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import token_count
from ..operators import build as B
from ..operators import conversation as C
from ..operators import enrich as Z
from ..operators import entities as E
from ..operators import history as H
from ..operators import retrieval as R
from ..operators import sessions as O
from ..operators import store as T
from ..plans.lineage import cut
from ..sources.tables import line_chunks, messages, spread, table
from .catalog import _CHUNKS, _COS, _TURNS, _entities, _terms, _tokens, LINKS_SQL, docs, note_links, query

_REF = "source || '/' || doc_id || '.md'"


def memory(spark: SparkSession, d: str, *wanted: str) -> T.Store:
    """A store of the documents: a third each from a folder, from sessions and as artifacts; lines are chunks.

    The first chunk of a document has the vector of its number. Only the tables in
    ``wanted`` are made besides sources, chunks and edges.
    """
    rows = spread(docs(spark, d))
    kind = F.element_at(F.array(*map(F.lit, ("directory", "conversation", "artifact"))), (F.col("doc_id") % 3 + 1).cast("int"))
    session = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 50).cast("string"))
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    sources = rows.select(name.alias("source_id"), kind.alias("source_type"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_ref"), session.alias("session_id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), token_count(F.coalesce("text", F.lit(""))).alias("token_count"), F.when(F.col("doc_id") % 4 == 0, "done").otherwise("pending").alias("entity_pass"))
    lines = line_chunks(rows).select(name.alias("source_id"), F.concat_ws("#", name, F.col("ord").cast("string")).alias("chunk_id"), "ord", "text", token_count(F.col("text")).alias("token_count"), "doc_id")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).cast("long").alias("ord"), "embedding")
    chunks = lines.join(vectors, ["doc_id", "ord"], "left").select("chunk_id", "source_id", "ord", "text", "token_count", "embedding")
    out = {"sources": sources, "chunks": chunks, "edges": B.sequence(chunks)}
    if "terms" in wanted:
        out["terms"] = R.term_freq(chunks, "chunk_id")
    if "entities" in wanted:
        out["entities"] = E.entity_counts(chunks, "chunk_id").withColumn("extractor", F.lit("heuristic"))
    if "sessions" in wanted:
        said = messages(table(spark, d, "conversations")).withColumn("session_id", F.col("session_id").cast("string"))
        out["messages"] = said
        out["sessions"] = said.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", F.lit("").alias("title"), F.lit("2024-01-01").alias("created_at"), F.lit(False).alias("pinned"))
    return out


_MEMORY = f"""{_CHUNKS},
sources AS (SELECT 's' || doc_id AS source_id, ['directory', 'conversation', 'artifact'][doc_id % 3 + 1] AS source_type, {_REF} AS source_ref, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 50 AS VARCHAR) END AS session_id, {_tokens("coalesce(text, '')")} AS token_count, CASE WHEN doc_id % 4 = 0 THEN 'done' ELSE 'pending' END AS entity_pass, doc_id FROM documents),
chunks AS (SELECT 's' || l.doc_id || '#' || ord AS chunk_id, 's' || l.doc_id AS source_id, CAST(ord AS BIGINT) AS ord, text, {_tokens("text")} AS token_count, e.embedding, l.doc_id FROM lines l LEFT JOIN embeddings e ON e.vec_id = l.doc_id AND l.ord = 1),
seq AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM chunks a JOIN chunks b ON a.source_id = b.source_id AND b.ord = a.ord + 1),
edges AS (SELECT a AS src, b AS dst, 'next' AS kind FROM seq UNION ALL SELECT b, a, 'prev' FROM seq)"""


def _replaced(spark: SparkSession, d: str, *wanted: str) -> T.Store:
    """Every tenth document gets two other chunks, and every 25th stands under another reference too."""
    store = memory(spark, d, *wanted)
    old = store["sources"].filter("cast(substring(source_id, 2) as long) % 10 = 0").select("source_type", "source_ref")
    extra = store["sources"].filter("cast(substring(source_id, 2) as long) % 25 = 0").select("source_type", F.concat(F.lit("new/"), "source_ref").alias("source_ref"))
    both = old.unionByName(extra)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source_id", "session_id", "title", "content_hash", "entity_pass")]
    new = both.select("*", *nothing, F.lit(0).cast("long").alias("token_count"))
    chunks = both.select("*", F.posexplode(F.array(F.concat(F.lit("first of "), "source_ref"), F.lit("second"))).alias("pos", "text"))
    chunks = chunks.select("source_type", "source_ref", (F.col("pos") + 1).cast("long").alias("ord"), "text", token_count(F.col("text")).alias("token_count"))
    return T.replace_sources(store, new, chunks)


_FRESH = f"""fresh AS (SELECT source_type, source_ref FROM sources WHERE doc_id % 10 = 0 UNION ALL SELECT source_type, 'new/' || source_ref FROM sources WHERE doc_id % 25 = 0),
made AS (SELECT source_ref, 1 AS ord, 'first of ' || source_ref AS text FROM fresh UNION ALL SELECT source_ref, 2, 'second' FROM fresh)"""


@query("replace_source", f"WITH {_MEMORY}, {_FRESH} SELECT source_ref, ord, text FROM chunks c JOIN sources s ON s.source_id = c.source_id WHERE s.doc_id % 10 <> 0 UNION ALL SELECT source_ref, CAST(ord AS BIGINT), text FROM made")
def _(spark, d):
    store = _replaced(spark, d)
    return store["chunks"].join(store["sources"].select("source_id", "source_ref"), "source_id").select("source_ref", "ord", "text")


@query("replace_source_rows", f"WITH {_MEMORY}, {_FRESH}, n AS (SELECT source_ref, CAST(sum({_tokens('text')}) AS BIGINT) AS t FROM made GROUP BY ALL) SELECT s.source_id, s.source_ref, coalesce(n.t, token_count) AS token_count, CASE WHEN n.t IS NULL THEN entity_pass ELSE 'pending' END AS entity_pass FROM sources s LEFT JOIN n USING (source_ref) UNION ALL SELECT sha256(source_type || chr(0) || source_ref), source_ref, t, 'pending' FROM fresh JOIN n USING (source_ref) WHERE starts_with(source_ref, 'new/')")
def _(spark, d):
    return _replaced(spark, d)["sources"].select("source_id", "source_ref", "token_count", "entity_pass")


@query("replace_source_edges", f"WITH {_MEMORY}, k AS (SELECT chunk_id FROM chunks WHERE doc_id % 10 <> 0) SELECT src, dst, kind FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def _(spark, d):
    return _replaced(spark, d)["edges"].select("src", "dst", "kind")


@query("session_delete", f"WITH {_MEMORY}, k AS (SELECT * FROM sources WHERE NOT coalesce(session_id = '7', false)), kc AS (SELECT chunk_id FROM chunks WHERE source_id IN (SELECT source_id FROM k)) SELECT 'sources' AS what, count(*) AS n FROM k UNION ALL SELECT 'chunks', count(*) FROM kc UNION ALL SELECT 'edges', count(*) FROM edges WHERE src IN (FROM kc) AND dst IN (FROM kc) UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id <> 7 UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations WHERE conv_id <> 7")
def _(spark, d):
    store = T.drop_session(memory(spark, d, "sessions"), "7")
    out = [store[n].agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")) for n in ("sources", "chunks", "edges", "messages", "sessions")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("folder_forget", f"WITH {_MEMORY} SELECT chunk_id FROM chunks WHERE source_id NOT IN (SELECT source_id FROM sources WHERE source_type = 'directory' AND starts_with(source_ref, 'src1/'))")
def _(spark, d):
    return T.forget_folder(memory(spark, d), "src1")["chunks"].select("chunk_id")


@query("artifact_repair", f"WITH {_MEMORY} SELECT source_ref FROM sources WHERE source_type <> 'artifact' OR doc_id % 2 = 0")
def _(spark, d):
    store = memory(spark, d)
    there = store["sources"].filter("source_type = 'artifact' and cast(substring(source_id, 2) as long) % 2 = 0").select(F.col("source_ref").alias("artifact_id"))
    return T.drop_orphan_artifacts(store | {"artifacts": there})["sources"].select("source_ref")


@query("memory_clear", f"WITH {_MEMORY} SELECT 'embedded' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'cleared', 0")
def _(spark, d):
    store = memory(spark, d)
    bare, count = T.without_vectors(store["chunks"]), F.count(F.lit(1))
    return bare.agg(F.lit("embedded").alias("what"), F.count("embedding").alias("n")).unionByName(bare.agg(F.lit("chunks").alias("what"), count.alias("n"))).unionByName(T.cleared(store)["chunks"].agg(F.lit("cleared").alias("what"), count.alias("n")))


def _stored_links(spark: SparkSession, d: str) -> DataFrame:
    return note_links(spark, d).select("from_ref", "to_ref", F.lit("").alias("heading"), F.concat(F.lit("[["), "to_ref", F.lit("]]")).alias("raw"), F.lit(False).alias("embed"), F.when(F.col("pos") == 2, "link_inferred").otherwise("link").alias("kind"))


_STORED = f"{LINKS_SQL}, stored AS (SELECT from_ref, to_ref, '' AS heading, '[[' || to_ref || ']]' AS raw, false AS embed, CASE WHEN pos = 2 THEN 'link_inferred' ELSE 'link' END AS kind FROM note_links)"


@query("replace_links", f"WITH {_STORED}, gone AS (SELECT ref FROM refs WHERE doc_id % 6 = 0), new AS (SELECT DISTINCT from_ref, to_ref, heading, 'again' AS raw, embed, 'link' AS kind FROM stored WHERE from_ref IN (FROM gone)) SELECT * FROM stored WHERE NOT (kind = 'link' AND from_ref IN (FROM gone)) UNION ALL SELECT * FROM new")
def _(spark, d):
    links = _stored_links(spark, d)
    refs = docs(spark, d).filter("doc_id % 6 = 0").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("from_ref"))
    noise = refs.select("from_ref", F.lit("").alias("to_ref"), F.lit("").alias("heading"), F.lit("again").alias("raw"), F.lit(False).alias("embed"), F.lit("x").alias("kind"))
    return T.replace_links(links, refs, links.withColumn("raw", F.lit("again")).unionByName(noise))


@query("edge_kinds_dropped", f"WITH {_MEMORY} SELECT src, dst, kind FROM edges WHERE kind <> 'prev'")
def _(spark, d):
    return T.drop_edge_kinds(memory(spark, d)["edges"], ["prev", "similar"]).select("src", "dst", "kind")


@query("entity_pass_done", f"WITH {_MEMORY} SELECT source_id, CASE WHEN token_count < 100 THEN 'failed' ELSE entity_pass END AS entity_pass FROM sources")
def _(spark, d):
    return T.set_where(memory(spark, d)["sources"], "token_count < 100", entity_pass=T.FAILED).select("source_id", "entity_pass")


@query("sessions_by_activity", "WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (role IN ('user', 'assistant')) AS message_count, max(turn + 1) FILTER (role IN ('user', 'assistant')) AS t FROM conversations GROUP BY 1) SELECT session_id, 'New Chat' AS title, message_count, coalesce('2024-02-' || lpad(CAST(t AS VARCHAR), 4, '0'), '2024-01-01') AS last_at FROM m ORDER BY last_at DESC, session_id LIMIT 40")
def _(spark, d):
    store = memory(spark, d, "sessions")
    timed = store["messages"].withColumn("at", F.concat(F.lit("2024-02-"), F.lpad(F.col("seq").cast("string"), 4, "0")))
    return T.sessions_by_activity(T.with_defaults(store["sessions"]), timed).limit(40)


@query("memory_stats", f"WITH {_MEMORY}, {_terms('chunks', 'chunk_id')}, {_entities('chunks', 'chunk_id')} SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE entity_pass = 'pending') AS pending, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(embedding) FROM chunks) AS embedded, (SELECT round(coalesce(avg(token_count), 0), 6) FROM chunks) AS avg_tokens, (SELECT count(DISTINCT term) FROM terms) AS terms, (SELECT count(DISTINCT kind || chr(0) || value) FROM ents) AS entities, (SELECT count(*) FROM edges) AS edges")
def _(spark, d):
    return T.memory_stats(memory(spark, d, "terms", "entities"))


@query("memory_status", f"WITH {_MEMORY} SELECT 'edges' AS what, kind AS name, count(*) AS n FROM edges GROUP BY kind UNION ALL SELECT 'sources', source_type, count(*) FROM sources GROUP BY source_type UNION ALL SELECT 'extraction', entity_pass, count(*) FROM sources GROUP BY entity_pass")
def _(spark, d):
    return T.status(memory(spark, d))


@query("entity_dictionary", f"WITH {_entities('documents', 'doc_id')}, k AS (SELECT DISTINCT kind, value FROM ents WHERE doc_id % 2 = 0) SELECT kind, value, 'old' AS entity_id FROM k UNION ALL SELECT kind, value, sha256(kind || chr(0) || value) FROM (SELECT DISTINCT kind, value FROM ents) WHERE (kind, value) NOT IN (SELECT (kind, value) FROM k)")
def _(spark, d):
    links = cut(E.entity_counts(spread(docs(spark, d))), "links")
    known = links.filter("doc_id % 2 = 0").select("kind", "value").distinct().withColumn("entity_id", F.lit("old"))
    return T.merge_dictionary(known, links)


@query("entity_prune", f"WITH {_entities('documents', 'doc_id')} SELECT DISTINCT kind, value FROM ents WHERE doc_id % 3 = 1")
def _(spark, d):
    links = E.entity_counts(spread(docs(spark, d)))
    return T.prune_dictionary(links.select("kind", "value").distinct(), links.filter("doc_id % 3 = 1"))


# ---- edges of a whole store ----

_SIM = f"""vs AS (SELECT chunk_id, embedding FROM chunks WHERE embedding IS NOT NULL),
sm AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, round({_COS.format(a="a.embedding", b="b.embedding")}, 6) AS similarity FROM vs a JOIN vs b ON a.chunk_id <> b.chunk_id),
tk AS (SELECT src, dst, similarity FROM sm QUALIFY count(*) OVER (PARTITION BY src ORDER BY similarity DESC RANGE UNBOUNDED PRECEDING) <= 8 AND similarity >= 0.3),
sim AS (SELECT a.src, a.dst, a.similarity FROM tk a JOIN tk b ON a.src = b.dst AND a.dst = b.src)"""


@query("store_similar", f"WITH {_MEMORY}, {_SIM} SELECT src, dst, similarity AS weight FROM sim")
def _(spark, d):
    return B.similar(memory(spark, d)["chunks"], least=0.3).select("src", "dst", "weight")


@query("store_similar_scoped", f"WITH {_MEMORY}, {_SIM}, c AS (SELECT chunk_id FROM chunks WHERE doc_id % 5 = 0) SELECT src, dst, similarity AS weight FROM sim WHERE src IN (FROM c) OR dst IN (FROM c)")
def _(spark, d):
    chunks = memory(spark, d)["chunks"]
    return B.similar(chunks, chunks.filter("cast(regexp_extract(source_id, '([0-9]+)', 1) as long) % 5 = 0").select("chunk_id"), least=0.3).select("src", "dst", "weight")


@query("store_links", f"""WITH {_MEMORY}, {LINKS_SQL}, nl AS (SELECT from_ref, to_ref, min(pos) AS pos FROM note_links GROUP BY ALL), firsts AS (SELECT s.source_ref AS ref, arg_min(chunk_id, ord) AS c FROM chunks JOIN sources s USING (source_id) WHERE source_type = 'directory' GROUP BY ALL)
SELECT a.c AS src, b.c AS dst, CASE WHEN pos = 2 THEN 'link_inferred' ELSE 'link' END AS kind, CAST(CASE WHEN pos = 2 THEN 0.8 ELSE 0.85 END AS DOUBLE) AS weight FROM nl JOIN firsts a ON a.ref = from_ref JOIN firsts b ON b.ref = to_ref WHERE a.c <> b.c""")
def _(spark, d):
    store = memory(spark, d)
    links = note_links(spark, d).groupBy("from_ref", "to_ref").agg(F.min("pos").alias("pos")).withColumns({"heading": F.lit(""), "raw": F.lit("[[not written]]"), "embed": F.lit(False), "kind": F.when(F.col("pos") == 2, "link_inferred").otherwise("link")})
    return B.linked(links, store["chunks"].withColumn("heading_path", F.lit("")), store["sources"])


_PROPOSED = f"""pr AS (SELECT 's' || doc_id AS source_id, doc_id, {_REF} AS own, text, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['', 'a', 'a', 'a', 'none', 'self']) AS what, unnest([0, 0, 1, 0, 0, 0]) AS quoted FROM documents),
pt AS (SELECT *, CASE what WHEN 'a' THEN 'T' || (doc_id + 3) WHEN 'none' THEN 'nowhere' WHEN 'self' THEN 'T' || doc_id ELSE '' END AS target, CASE WHEN quoted = 1 THEN 'zq zq zq' ELSE split_part(coalesce(text, ''), ' ', 1) END AS evidence FROM pr),
rs AS (SELECT 'T' || doc_id AS target, {_REF} AS to_ref FROM documents)"""


@query("link_guard", f"WITH {_PROPOSED}, j AS (SELECT pt.*, rs.to_ref, CASE WHEN pt.target = '' THEN 'no target' WHEN trim(evidence) = '' OR NOT contains(lower(coalesce(text, '')), lower(trim(evidence))) THEN 'no evidence' WHEN rs.to_ref IS NULL THEN 'unresolved' WHEN rs.to_ref = own THEN 'itself' END AS r FROM pt LEFT JOIN rs ON rs.target = pt.target) SELECT source_id, pos, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY source_id, r, to_ref ORDER BY pos) > 1 THEN 'repeated' ELSE r END AS reject_reason FROM j")
def _(spark, d):
    rows = docs(spark, d)
    ref = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    name = lambda c: F.concat(F.lit("T"), c.cast("string"))
    sources = rows.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), ref.alias("source_ref"), "text", "doc_id")
    told = F.array(*[F.struct(F.lit(p).alias("pos"), t.alias("target"), F.lit(q).alias("quoted")) for p, t, q in ((0, F.lit(""), 0), (1, name(F.col("doc_id") + 3), 0), (2, name(F.col("doc_id") + 3), 1), (3, name(F.col("doc_id") + 3), 0), (4, F.lit("nowhere"), 0), (5, name(F.col("doc_id")), 0))])
    word = F.coalesce(F.try_element_at(F.split(F.coalesce("text", F.lit("")), " "), F.lit(1)), F.lit(""))
    proposed = sources.select("source_id", word.alias("word"), F.explode(told).alias("t")).select("source_id", "t.pos", "t.target", F.when(F.col("t.quoted") == 1, "zq zq zq").otherwise(F.col("word")).alias("evidence"))
    return B.guard_links(proposed, sources, sources.select(name(F.col("doc_id")).alias("target"), F.col("source_ref").alias("to_ref"))).select("source_id", "pos", "reject_reason")


@query("link_report", f"WITH {_MEMORY}, {LINKS_SQL}, x AS (SELECT from_ref, CASE WHEN pos = 1 THEN '' ELSE to_ref END AS to_ref, pos FROM note_links), r AS (SELECT DISTINCT source_ref FROM chunks JOIN sources USING (source_id) WHERE source_type = 'directory'), y AS (SELECT *, to_ref <> '' AS ok, from_ref IN (FROM r) AND to_ref IN (FROM r) AS ends FROM x) SELECT count(*) AS links, count_if(NOT ok) AS unresolved, count_if(ok AND NOT ends) AS no_chunk, count_if(ok AND ends AND pos = 2) AS heading_missed, round(count_if(NOT ok) / count(*), 6) AS unresolved_share FROM y")
def _(spark, d):
    store = memory(spark, d)
    links = note_links(spark, d).select("from_ref", F.when(F.col("pos") == 1, "").otherwise(F.col("to_ref")).alias("to_ref"), F.when(F.col("pos") == 2, "lost").when(F.col("pos") == 3, "PART ").alias("heading"))
    notes = store["sources"].filter("source_type = 'directory'").select("source_id", F.col("source_ref").alias("ref"))
    return B.link_report(links, store["chunks"].join(notes, "source_id").select("ref", F.lit("Top › Part").alias("heading_path")))


@query("note_names", f"SELECT ref, regexp_extract(ref, '([^/]*)\\.md$', 1) AS name FROM (SELECT {_REF} AS ref FROM documents) WHERE ref <> 'src0/0.md' ORDER BY ref LIMIT 200")
def _(spark, d):
    refs = docs(spark, d).select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("ref"))
    return B.note_names(refs, "src0/0.md")


@query("rand_index", "WITH r AS (SELECT lang, source FROM documents), c AS (SELECT lang, source, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY lang)) AS pa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY source)) AS pb, (SELECT count(*) * (count(*) - 1) / 2 FROM r) AS t) SELECT round((t + 2 * ab - pa - pb) / t, 6) AS rand_index FROM p")
def _(spark, d):
    return B.rand_index(docs(spark, d), "lang", "source")


# ---- columns over rows of the tables ----


@query("text_clips", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || chr(10) || chr(10) || '[… truncated]' ELSE text END AS clipped, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n_words, CASE WHEN n_chars < 1000 THEN CAST(n_chars AS VARCHAR) WHEN n_chars < 10000 THEN ((n_chars + 50) // 1000) || '.' || ((n_chars + 50) // 100 % 10) || 'k' ELSE ((n_chars + 500) // 1000) || 'k' END AS size FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.clip_chars(F.col("text"), 200).alias("clipped"), X.word_count(F.coalesce("text", F.lit(""))).alias("n_words"), X.short_number(F.col("n_chars")).alias("size"))


@query("slugs", "SELECT doc_id, trim(regexp_replace(lower(substring(coalesce(text, ''), 1, 40)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.slug(F.substring(F.coalesce("text", F.lit("")), 1, 40)).alias("slug"))


@query("line_set", "SELECT doc_id, array_to_string(l, chr(10)) AS lines FROM (SELECT doc_id, list_filter(t, lambda x, i: x <> '' AND list_position(t, x) = i) AS l FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS t FROM documents))")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(X.ordered_distinct(F.split(F.coalesce("text", F.lit("")), "\n")), "\n").alias("lines"))


@query("daily_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date FROM events")
def _(spark, d):
    t, i = F.col("ts"), F.col("event_id") % 4
    name = F.when(i == 0, F.date_format(t, "yyyy-MM-dd 'notes.md'")).when(i == 1, F.concat(F.lit("d/"), F.date_format(t, "yyyyMMdd"))).when(i == 2, F.date_format(t, "yyyy_MM_dd'.markdown'")).otherwise(F.date_format(t, "yyyy-MM-dd EEEE"))
    return table(spark, d, "events").select("event_id", X.daily_date(name).alias("date"))


@query("flat_fields", "SELECT doc_id, lang AS name, CAST(doc_id % 7 AS VARCHAR) AS max_tokens, coalesce(ltrim(text, chr(10)), '') AS body FROM documents")
def _(spark, d):
    made = F.concat(F.lit("---\nname: "), "lang", F.lit("\nmax_tokens: 1\n max_tokens :  "), (F.col("doc_id") % 7).cast("string"), F.lit(" \nother\n---\n\n"), F.coalesce("text", F.lit("")))
    rows = docs(spark, d).select("doc_id", made.alias("text"))
    return rows.select("doc_id", X.flat_field(F.col("text"), "name").alias("name"), X.flat_field(F.col("text"), "max_tokens").alias("max_tokens"), X.flat_body(F.col("text")).alias("body"))


# ---- history and artifacts ----

_HISTORY = f"""{_TURNS}, h AS (SELECT session_id, session_id || '#' || start_seq || '-' || reply_at AS source_ref, sha256('User: ' || regexp_replace(user_text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Assistant: ' || regexp_replace(reply, '^\\s+|\\s+$', '', 'g') || chr(0)) AS content_hash FROM s WHERE skip_reason IS NULL)"""


@query("history_work", f"WITH {_HISTORY} SELECT source_ref, content_hash, CASE WHEN session_id % 3 <> 0 THEN 'added' WHEN session_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS action FROM h")
def _(spark, d):
    said = messages(table(spark, d, "conversations"))
    found = H.turn_sources(said.select("session_id", F.lit("").alias("title")).distinct(), said)
    # Every third session is stored already, every other one of these as it was before a change.
    stored = found.filter("session_id % 3 = 0").select("source_type", "source_ref", F.when(F.col("session_id") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return H.with_action(found, stored).select("source_ref", "content_hash", "action")


@query("history_skips", f"WITH {_TURNS} SELECT coalesce(skip_reason, 'accepted') AS outcome, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    return C.turns(messages(table(spark, d, "conversations"))).groupBy(F.coalesce("skip_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_KIND = "['markdown', 'python', 'sql', 'text', 'yaml', 'html', '', 'other'][doc_id % 8 + 1]"


@query("artifact_exports", rf"""WITH t AS (SELECT doc_id, regexp_replace(trim(substring(coalesce(text, ''), 1, 24)), '[\/:*?"<>|]+', '_', 'g') AS name, {_KIND} AS kind FROM documents)
SELECT doc_id, CASE WHEN name = '' THEN 'artifact' ELSE name END || '.' || CASE kind WHEN 'markdown' THEN 'md' WHEN 'python' THEN 'py' WHEN 'sql' THEN 'sql' WHEN 'yaml' THEN 'yaml' WHEN 'html' THEN 'html' ELSE 'txt' END AS file_name FROM t""")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("markdown", "python", "sql", "text", "yaml", "html", "", "other"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs(spark, d).select("doc_id", O.export_name(F.substring(F.coalesce("text", F.lit("")), 1, 24), kind).alias("file_name"))


# ---- replies of an extractor ----


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth document's reply is broken off, every seventh's lacks the links, every eleventh has none."""
    whole = F.struct(F.array(F.struct(F.lit("org").alias("kind"), F.col("source").alias("value")), F.struct(F.lit("proper").alias("kind"), F.col("lang").alias("value"))).alias("entities"), F.when(F.col("doc_id") % 7 != 0, F.array(F.struct(F.col("source").alias("target"), F.substring("text", 1, 20).alias("evidence")))).alias("links"))
    reply = F.to_json(whole)
    return docs(spark, d).select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.expr("substring(to_json(struct(source)), 1, 8)")).otherwise(reply).alias("reply"))


_ANSWERED = "a AS (SELECT * FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0)"


@query("typed_entities", f"WITH {_ANSWERED} SELECT doc_id AS source_id, 0 AS pos, 'org' AS kind, source AS value FROM a UNION ALL SELECT doc_id, 1, 'proper', lang FROM a")
def _(spark, d):
    return Z.typed(_replies(spark, d))[0]


@query("typed_links", f"WITH {_ANSWERED} SELECT doc_id AS source_id, 0 AS pos, source AS target, substring(text, 1, 20) AS quote FROM a WHERE doc_id % 7 <> 0")
def _(spark, d):
    return Z.typed(_replies(spark, d))[1]


@query("failed_replies", "SELECT doc_id AS source_id FROM documents WHERE doc_id % 11 = 0 OR doc_id % 5 = 0")
def _(spark, d):
    return Z.typed(_replies(spark, d))[2]
