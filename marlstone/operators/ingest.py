"""Notes and pages to blocks, chunks, vectors: Arrow-batched functions over whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, community, embedding, markdown, prose, web
from ..functions.text import daily_date, entity_array, first_words, folded, ordered_distinct, terms, trimmed, word_count
from ..plans.lineage import bound_batches, cut
from ..sources import files
from . import build, entities, graph, maintain, retrieval, store
from .conversation import thread_context
from .dedup import MIN_BYTES, NEAR, PROBES, dice_of, gram_sets


def each(rows: DataFrame, id_col: str, text_col: str, schema: str, f: Callable[[str], list[tuple]]) -> DataFrame:
    """(id, *fields) for every tuple that ``f`` makes of a row's text; null counts as empty.

    Rows stay where they are: one pass, no shuffle, batches of bounded size.
    """
    bound_batches(rows.sparkSession, rows=500, megabytes=8)
    out = rows.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    full = f"{id_col} {out.schema[id_col].dataType.simpleString()}, {schema}"
    names = [x.strip().split(" ")[0] for x in full.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, *t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in f(text)]
            for lo in range(0, len(made), 2000):
                columns = list(zip(*made[lo : lo + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *map(pa.array, columns[1:])], names=names)

    return out.mapInArrow(run, full)


def note_blocks(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return each(notes, id_col, text_col, "ord long, kind string, block string, heading_path string, level long, start_line long", lambda t: [(i + 1, b.kind, b.text, b.heading_path, b.level, b.start_line) for i, b in enumerate(markdown.blocks(markdown.split_front_matter(t)[1]))])


KINDS = ("headings", "communities", "semantic")


def chunker(kind: str = "headings", count: chunking.Counter = prose.estimate_tokens, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Callable[[str], list[chunking.Chunk]]:
    """What cuts a text: by ``headings``, by lexical ``communities`` of sentences, or by ``semantic`` ones of their vectors."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    if kind == "headings":
        return lambda t: chunking.by_headings(markdown.blocks(t), count)
    alike = community.similarities if kind == "communities" else community.semantic(embed or embedding.HashEmbedder())
    return lambda t: chunking.by_communities(markdown.blocks(t), count, alike)


_CHUNK = "ord long, chunk string, heading_path string, token_count long, community long"


def _rows(chunks: list[chunking.Chunk]) -> list[tuple]:
    return [(i + 1, c.text, c.heading_path, c.tokens, c.community) for i, c in enumerate(chunks)]


def note_chunks(notes: DataFrame, kind: str = "headings", id_col: str = "doc_id", text_col: str = "text", count: chunking.Counter = prose.estimate_tokens, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Chunks of notes, their front matter left out; token counter and embedder can be exchanged."""
    cut_up = chunker(kind, count, embed)
    return each(notes, id_col, text_col, _CHUNK, lambda t: _rows(cut_up(markdown.split_front_matter(t)[1])))


def artifact_chunks(artifacts: DataFrame) -> DataFrame:
    """Chunks of artifacts (artifact_id, title, content_type, content); title and type lead every heading path."""
    chunks = each(artifacts.withColumn("content", trimmed(F.coalesce("content", F.lit("")))), "artifact_id", "content", _CHUNK, lambda t: _rows(chunker()(t)))
    title, kind = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled artifact")), F.coalesce("content_type", F.lit(""))
    lead = F.when(kind.isin("", "text"), title).otherwise(F.concat(title, F.lit(" ("), kind, F.lit(")")))
    out = chunks.join(artifacts.select("artifact_id", lead.alias("lead")), "artifact_id")
    return out.withColumn("heading_path", F.concat_ws(markdown.PATH_JOIN, "lead", F.nullif("heading_path", F.lit("")))).drop("lead")


#: Fixed value: words of the hidden reasoning that lead to a turn.
COT_WORDS = 64


def turn_chunks(pairs: DataFrame, title: Column) -> DataFrame:
    """Chunks of turn pairs with ``terms`` and ``entities``; the turn's title and number lead every heading path.

    Terms cover the thread's context and the first words of the hidden reasoning too,
    so that words found there lead to the turn; entities are of what can be returned
    only, and the reasoning itself isn't among the columns.
    """
    lead = F.format_string(f"%s{markdown.PATH_JOIN}turn %s", F.coalesce(F.nullif(title, F.lit("")), F.lit("Conversation")), F.col("start_seq").cast("string"))
    rows = pairs.select("*", thread_context(title, F.col("prev_gist")).alias("thread"), lead.alias("lead"), first_words(F.col("cot"), COT_WORDS).alias("note"))
    chunks = each(rows, "ref", "turn_text", _CHUNK, lambda t: _rows(chunker()(t)))
    kept = [c for c in ("session_id",) if c in rows.columns]
    out = chunks.join(rows.select("ref", *kept, "thread", "lead", "note"), "ref")
    index = terms(F.concat_ws("\n", "chunk", F.nullif("thread", F.lit("")), "note"))
    path = F.concat_ws(markdown.PATH_JOIN, "lead", F.nullif("heading_path", F.lit("")))
    return out.withColumn("heading_path", path).withColumn("terms", index).withColumn("entities", entity_array(F.col("chunk"))).drop("note", "lead")


def note_metadata(notes: DataFrame, ref_col: str = "ref", text_col: str = "text") -> DataFrame:
    """(ref, title, tags, dates, aliases) of notes.

    The title is that of the front matter or the file's name; tags are inline ones
    and the front matter's; dates come from the name, then from ``date``,
    ``created`` and ``updated``.
    """

    def look(text: str) -> list[tuple]:
        head = markdown.front_matter(text)
        tags = markdown.tags(markdown.split_front_matter(text)[1]) + [t.strip().lstrip("#").lower() for t in head.get("tags", [])]
        days = [v[:10] for key in ("date", "created", "updated") for v in head.get(key, [])]
        return [((head.get("title") or [""])[0], tags, days, head.get("aliases", []))]

    rows = each(notes, ref_col, text_col, "title string, tags array<string>, days array<string>, aliases array<string>", look)
    name = F.regexp_replace(F.regexp_extract(ref_col, r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    dates = F.concat(F.array(daily_date(F.col(ref_col))), F.filter("days", lambda v: v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")))
    return rows.select(ref_col, F.coalesce(F.nullif("title", F.lit("")), name).alias("title"), ordered_distinct(F.col("tags")).alias("tags"), ordered_distinct(F.filter(dates, lambda v: v.isNotNull())).alias("dates"), "aliases")


def sentence_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return each(documents, id_col, text_col, "ord long, sentence string", lambda t: [(i + 1, s) for i, s in enumerate(prose.sentences(t))])


def note_front_matter(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return each(notes, id_col, text_col, "key string, value string", lambda t: [(k, v) for k, vs in markdown.front_matter(t).items() for v in vs])


def note_links(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return each(notes, id_col, text_col, "target string, heading string, alias string, embed boolean, raw string", lambda t: [tuple(x.values()) for x in markdown.links(t)])


def note_tags(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return each(notes, id_col, text_col, "tag string", lambda t: [(x,) for x in markdown.tags(t)])


def page_text(pages: DataFrame) -> DataFrame:
    return each(pages, "page_id", "html", "visible string", lambda t: [(web.visible_text(t),)])


def page_articles(pages: DataFrame) -> DataFrame:
    return each(pages, "page_id", "html", "article string", lambda t: [(web.article(t),)])


#: Fixed value: an article of fewer words is thin.
THIN = 150


def word_gate(pages: DataFrame) -> DataFrame:
    """(page_id, n_words, thin): words of each page's article, and whether these are too few."""
    n = word_count(F.col("article"))
    return page_articles(pages).select("page_id", n.alias("n_words"), (n < THIN).alias("thin"))


def page_tables(pages: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """(page_id, data_table) of pages (page_id, url, html) with a table that a script fills; ``fetch`` gives the response of an address, or None.

    The address leads the text through the pass, so that a page's own links resolve;
    pages without such a table have no row.
    """
    joined = pages.select("page_id", F.concat(F.coalesce("url", F.lit("")), F.lit("\0"), F.coalesce("html", F.lit(""))).alias("both"))

    def look(both: str) -> list[tuple]:
        url, page = both.split("\0", 1)
        found = web.fetched_table(page, url, fetch)
        return [(found,)] if found else []

    return each(joined, "page_id", "both", "data_table string", look)


def page_scripts(pages: DataFrame) -> DataFrame:
    return each(pages, "page_id", "html", "kind string, script string", lambda t: [(k, s) for k, v in web.scripts(t).items() for s in v])


def page_state(pages: DataFrame) -> DataFrame:
    return each(pages, "page_id", "html", "state string", lambda t: [(web.state_text(t),)])


def text_vectors(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: int = embedding.DIMENSIONS, embedder: embedding.Embedder | None = None) -> DataFrame:
    """(id, embedding): vectors of whole batches of texts by any embedder, the hashed one by default."""
    embedder = embedder or embedding.HashEmbedder(dims)
    bound_batches(rows.sparkSession, rows=500, megabytes=8)
    out = rows.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(embedder(batch.column(1).to_pylist()), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return out.mapInArrow(run, f"{id_col} {out.schema[id_col].dataType.simpleString()}, embedding array<float>")


def backfill(chunks: DataFrame, id_col: str, text_col: str, dims: int = embedding.DIMENSIONS, embedder: embedding.Embedder | None = None) -> DataFrame:
    """Vectors for rows without one; others stay."""
    made = text_vectors(chunks.filter(F.col("embedding").isNull()), id_col, text_col, dims, embedder).withColumnRenamed("embedding", "made")
    return chunks.join(made, id_col, "left").withColumn("embedding", F.coalesce("embedding", F.col("made").cast(chunks.schema["embedding"].dataType))).drop("made").select(*chunks.columns)


def reject_near_copies(new: DataFrame, stored: DataFrame, least: float = NEAR) -> DataFrame:
    """``new`` chunks (ref, ord, text) with ``near_copy``: whether they repeat a stored chunk (ref, text) of another source or an accepted one of their own.

    Stored chunks are candidates if they share one of the six terms that occur
    least in a new chunk; there is no limit on how many.  Inside a source chunks
    are taken in order, and a note is of bounded size.
    """
    bound_batches(new.sparkSession, rows=500, megabytes=8)
    new = new.withColumn("uid", F.sha2(F.concat_ws("\0", "ref", F.col("ord").cast("string")), 256))
    probes = new.select("uid", "ref", F.explode(rare_of(F.col("text"))).alias("term")).distinct()
    olds = stored.select(F.col("ref").alias("other"), F.sha2("text", 256).alias("key"), "text")
    held = olds.select("other", "key", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    met = probes.join(held, "term").filter("ref <> other").select("uid", "key").distinct()
    texts = olds.groupBy("key").agg(F.first("text").alias("text"))
    sets = lambda df, k: df.select(k, folded(F.col("text")).alias("text")).mapInArrow(gram_sets(k), f"{k} string, grams binary, n long")
    mine = cut(sets(new, "uid"), "new-grams")
    theirs = sets(texts, "key").select("key", F.col("grams").alias("grams_2"), F.col("n").alias("m"))
    size = F.least("n", "m") >= least / (2 - least) * F.greatest("n", "m")
    near = met.join(mine, "uid").join(theirs, "key").filter(size).select("uid", "grams", "grams_2").mapInArrow(dice_of(least), "uid string").distinct().withColumn("copied", F.lit(True))

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        taken: list[set] = []
        out = []
        for row in table.sort_by("ord").to_pylist():
            grams = set(memoryview(row["grams"]).cast("q"))
            copy = bool(row["copied"]) or any(2 * len(grams & g) >= least * (len(grams) + len(g)) for g in taken)
            if not copy:
                taken.append(grams)
            out.append((row["uid"], copy))
        return pa.table({"uid": pa.array([u for u, _ in out], pa.string()), "near_copy": pa.array([c for _, c in out], pa.bool_())})

    judged = new.select("uid", "ref", "ord").join(mine, "uid").join(near, "uid", "left").groupBy("ref").applyInArrow(fold, "uid string, near_copy boolean")
    return new.join(judged, "uid").drop("uid")


def rare_of(text: Column) -> Column:
    """The six terms of at least four bytes that occur least in a text, ties by the term."""
    all_ = F.filter(terms(text), lambda w: F.octet_length(w) >= MIN_BYTES)
    counted = F.transform(F.array_distinct(all_), lambda w: F.struct(F.size(F.filter(all_, lambda x: x == w)).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted), 1, PROBES), lambda s: s["w"])


def ingest_folder(spark: SparkSession, root: str, known: store.Store, kind: str = "headings", embedder: embedding.Embedder | None = None) -> tuple[store.Store, DataFrame]:
    """The store after a folder of notes was read, and (action, n) of what was found.

    Unchanged files aren't opened for more than their hash, which is compared with
    the stored one; added and changed notes replace what is stored of them, removed
    ones go with all that hangs on them.  Chunks that nearly repeat others are left
    out; links are resolved against all notes and edges updated for what changed.
    """
    embedder = embedder or embedding.HashEmbedder()
    present = files.scan_notes(spark, root).withColumn("hash", F.sha2("content", 256))
    old = known["sources"].filter("source_type = 'directory'").select(F.col("source_ref").alias("ref"), F.lit(-1).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.col("content_hash").alias("hash"))
    diff = cut(maintain.snapshot_diff(old, present.select("ref", "size", "mtime", "hash")), "diff")
    work = cut(present.join(diff.filter("action in ('added', 'changed')"), "ref", "left_semi").select("ref", F.col("content").alias("text"), "hash", "size"), "notes")
    chunks = note_chunks(work, kind, "ref").withColumnRenamed("chunk", "text")
    stored = known["chunks"].join(known["sources"].select("source_id", F.col("source_ref").alias("ref")), "source_id").select("ref", "text")
    chunks = cut(reject_near_copies(chunks, stored).filter("not near_copy").drop("near_copy", "community"), "chunks")
    meta = cut(note_metadata(work), "metadata")
    head = work.join(meta.select("ref", "title"), "ref").select(F.lit("directory").alias("source_type"), F.col("ref").alias("source_ref"), F.lit(None).cast("string").alias("session_id"), "title", F.col("hash").alias("content_hash"), F.lit(0).cast("long").alias("token_count"), F.lit(None).cast("string").alias("entity_pass"))
    gone = known["sources"].join(diff.filter("action = 'removed'").select(F.col("ref").alias("source_ref")), "source_ref", "left_semi").filter("source_type = 'directory'")
    next_ = store.replace_sources(store.drop_sources(known, gone), head, chunks.withColumnRenamed("ref", "source_ref").withColumn("source_type", F.lit("directory")))
    next_["sources"], next_["chunks"] = cut(next_["sources"], "sources"), cut(backfill(next_["chunks"], "chunk_id", "text", embedder=embedder), "chunks")
    mine = next_["sources"].join(work.select(F.col("ref").alias("source_ref")), "source_ref", "left_semi").filter("source_type = 'directory'").select("source_id")
    fresh = next_["chunks"].join(mine, "source_id", "left_semi")
    next_["terms"] = cut(next_["terms"].unionByName(retrieval.term_freq(fresh, "chunk_id")), "terms")
    next_["entities"] = cut(next_["entities"].unionByName(entities.entity_counts(fresh, "chunk_id").withColumn("extractor", F.lit("heuristic"))), "entities")
    notes = present.select(F.col("ref").alias("path"), F.col("content").alias("text"))
    names = note_metadata(notes.withColumnRenamed("path", "ref")).select(F.col("ref").alias("path"), "aliases")
    raw = note_links(work, "ref").withColumnRenamed("ref", "from_ref")
    links = graph.resolve_links(raw.withColumn("kind", F.lit("link")), names).filter("to_ref is not null").withColumn("pos", F.xxhash64("raw"))
    columns = known["links"].columns
    kept = known["links"].join(gone.select(F.col("source_ref").alias("from_ref")), "from_ref", "left_anti").select(*columns)
    next_["links"] = cut(store.replace_links(kept, work.select(F.col("ref").alias("from_ref")), links.select(*columns)), "links")
    located = next_["links"] if "pos" in columns else next_["links"].withColumn("pos", F.xxhash64("raw"))
    next_["edges"] = cut(build.update_edges(next_["edges"], next_["sources"], next_["chunks"], located, next_["entities"], mine), "edges")
    return next_, diff.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
