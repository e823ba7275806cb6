"""Operators on small tables, and every query against its SQL."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import conversation, dedup, graph, maintain, search, tiles
from marlstone.plans import catalog, catalog_store
from marlstone.plans.lineage import cut, release
from marlstone.sources import files
from marlstone.streaming import incremental

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(catalog.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in duck.description]
    out = catalog.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, out.select(*columns).collect()))) == sorted(map(str, want))


@needs_tables
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_runs(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    assert len(out.collect()) > 0 or name == "page_state"


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, kind string, weight double")


def test_walk(spark):
    e = edges(spark, [("s", "a", "link", 1.0), ("a", "b", "similar", 0.8), ("c", "s", "link", 0.5), ("s", "x", "strange", 1.0), ("b", "d", "next", 1.0), ("a", "s", "next", 1.0), ("s", "e", "entity", 0.0001)])
    seeds = spark.createDataFrame([("s", 1.0)], "node string, score double")
    got = {r["node"]: (round(r["score"], 6), r["hops"]) for r in graph.walk(e, seeds).collect()}
    assert got == {"a": (0.6, 1), "c": (0.3, 1), "b": (0.192, 2)}
    hub = edges(spark, [("s", f"n{i:03}", "link", 1 - i / 1000) for i in range(200)])
    assert graph.walk(hub, seeds).count() == graph.MAX_FRONTIER


def test_turns(spark):
    rows = [(1, 1, "user", "hi", None), (1, 2, "cot", "think", None), (1, 3, "tool", "t", None), (1, 4, "assistant", "yo", None), (1, 5, "user", "plan", "manage_plan"), (1, 6, "assistant", "ok", None), (1, 7, "user", "again", None), (1, 8, "assistant", "  ", None), (1, 9, "user", "x" * 200_001, None), (1, 10, "assistant", "y", None), (1, 11, "user", "bye", None), (1, 12, "assistant", "z", None), (1, 13, "cot", "late", None)]
    m = spark.createDataFrame(rows, "session_id long, seq int, role string, content string, tool_name string")
    pairs = {r["start_seq"]: r for r in conversation.turn_pairs(m).collect()}
    assert set(pairs) == {1, 11} and pairs[1]["cot"] == "think" and pairs[11]["prev_gist"] == "hi" and pairs[11]["cot"] is None
    skips = {r["start_seq"]: r["skip_reason"] for r in conversation.turns(m).collect() if r["skip_reason"]}
    assert skips == {5: "plan-driven", 7: "no reply", 9: "too long"}


def test_words_are_those_of_the_article(spark):
    from marlstone.functions import web
    from marlstone.operators import ingest

    body = " ".join(f"word{i}" for i in range(160))
    pages = [(1, f"<html><body><nav>{body}</nav><article><h1>A b</h1><p>{body[:200]}</p></article></body></html>"), (2, f"<body><article><p>{body}</p></article></body>"), (3, ""), (4, None)]
    out = {r["page_id"]: (r["n_words"], r["thin"]) for r in ingest.word_gate(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert out == {i: (n := len(web.article(h or "").split()), n < 150) for i, h in pages} and out[2] == (160, False) and out[1][1] and out[1][0] > 10


def test_tables_of_pages_are_fetched(spark):
    from marlstone.operators import ingest

    page = "<script>DataTable('#t', {ajax: 'rows?a=1'})</script><table id=t><thead><tr><th>n</th></tr></thead></table>"
    pages = spark.createDataFrame([(1, "http://h/x/", page), (2, "http://h/x/", "<p>none</p>"), (3, None, page), (4, "http://h/", None)], "page_id long, url string, html string")
    got = [tuple(r) for r in ingest.page_tables(pages, lambda url: f'[["{url}"]]').collect()]
    assert got == [(1, "| n |\n| --- |\n| http://h/x/rows?a=1 |")]


def test_near_pairs_match_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven grey herons watch"
    rows = [(1, base), (2, base.replace("seven", "eight")), (3, "nothing alike at all in here"), (4, base), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["a"], r["b"]) for r in dedup.near_pairs(docs).collect()]
    assert got == [(1, 2)]
    assert [(r["first_id"], r["copies"]) for r in dedup.exact_copies(docs).orderBy("first_id").collect()] == [(1, 2), (5, 2)]


def test_selection_is_greedy():
    rows = pd.DataFrame({"doc_id": [1, 2, 3, 4], "source": list("abcd"), "fused": [0.9, 0.8, 0.7, 0.6], "token_count": [1500, 10, 1000, 400], "text": ["alpha beta gamma", "Alpha beta  gamma", "other words", "third one"]})
    assert search.select_results(rows, 6, 2000)["doc_id"].tolist() == [1, 4]
    assert search.select_results(rows, 6, 10)["doc_id"].tolist() == [1]
    assert search.select_results(rows.iloc[:0], 6, 10).empty


@needs_tables
def test_search_without_vectors_still_answers(spark):
    docs, asked = catalog.docs(spark, SF), catalog.asked(spark, SF)
    out = search.search(docs, None, asked, None, options=search.Options(limit=3, mode="rrf")).collect()
    assert 1 <= len(out) <= 3 and len({r["source"] for r in out}) == len(out)


def test_search_returns_documents_that_only_an_edge_reaches(spark):
    rows = [(1, "alpha beta words", "a"), (2, "nothing in common", "b"), (3, "neither has this", "c"), (4, "nor this one here", "d"), (5, "alpha again", "e"), (6, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    asked = spark.createDataFrame([("alpha beta",)], "text string")
    links = [(1, 2, "link", 1.0), (2, 3, "next", 1.0), (1, 4, "link", 0.5), (1, 6, "link", 0.9), (1, 99, "link", 0.8), (1, 5, "link", 0.5)]
    edges = spark.createDataFrame(links, "src long, dst long, kind string, weight double")
    run = lambda edges, **o: {r["doc_id"]: r["fused"] for r in search.search(docs, None, asked, None, edges, search.Options(**o)).collect()}
    plain, walked = run(None), run(edges)
    assert set(plain) == {1, 5} and set(walked) == {1, 2, 3, 4, 5, 6}
    for node, gain in ((2, 0.6), (3, 0.3), (4, 0.3), (6, 0.54)):
        assert walked[node] == pytest.approx(plain[1] * gain)
    # A candidate that the walk reaches too is raised by a quarter of the walk's score, not added again.
    assert walked[1] == plain[1] and walked[5] == pytest.approx(plain[5] + 0.25 * plain[1] * 0.3)
    assert set(run(edges, exclude_source="b")) == {1, 3, 4, 5, 6} and set(run(edges, source_types=["a", "d"])) == {1, 4}


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(maintain.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(maintain.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    paths = spark.createDataFrame([("/vault",), ("/vault/x",), ("/vault-archive/x",)], "p string")
    assert rows(paths.filter(maintain.under_root("p", "'/vault'"))) == [("/vault",), ("/vault/x",)]
    chunks = spark.createDataFrame([(1, [0.5], "m"), (2, [0.5, 1.0], "m"), (3, [0.5], "n")], "id int, embedding array<double>, embed_model string")
    assert [r["id"] for r in maintain.null_vectors(chunks, "m", 1).filter("embedding is not null").collect()] == [1]


def test_files(spark, tmp_path):
    for name, text in (("a.md", "# A"), ("sub/b.markdown", "b"), (".trash/c.md", "c"), ("node_modules/d.md", "d"), ("e.txt", "e")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = [(r["ref"], r["content"]) for r in files.scan_notes(spark, str(tmp_path)).collect()]
    assert got == [("a.md", "# A"), ("sub/b.markdown", "b")]
    assert "content" not in files.scan_notes(spark, str(tmp_path), with_content=False).columns
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            files.contained(str(tmp_path), bad)
    assert files.replace_once("abc", "b", "x") == "axc"
    with pytest.raises(ValueError):
        files.replace_once("abcb", "b", "x")
    path = str(tmp_path / "c.json")
    files.merge_config(path, {"a": 1, "b": 2})
    assert files.merge_config(path, {"a": None, "c": 3}) == {"b": 2, "c": 3}


def test_stream_takes_each_change_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    rows = [("a", "x", "2024-01-01 00:00:00"), ("a", "y", "2024-01-02 00:00:00"), ("b", "z", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "ref string, content string, mtime string").withColumn("mtime", F.to_timestamp("mtime")).coalesce(1).write.parquet(source)
    known = spark.createDataFrame([("b", "z")], "ref string, content string").select("ref", F.sha2("content", 256).alias("hash"))
    q = incremental.ingest_stream(spark, source, "ref string, content string, mtime timestamp", lambda: known, lambda df: seen.extend(df.select("ref", "content").collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [tuple(r) for r in seen] == [("a", "y")]


def test_cut_tables_can_be_released(spark):
    t = cut(spark.range(5), "t")
    assert t.count() == 5
    release(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._marlstone_path).count()


def test_enrichment(spark):
    from marlstone.operators import enrich

    sources = spark.createDataFrame([(1, "Ada Lovelace wrote to ada. Spark runs."), (2, None)], "source_id long, text string")
    found = enrich.extract(sources, lambda t: [("person", "Ada"), ("Person", " ada "), ("proper", "Spark"), ("code", "Hadoop"), ("thing", "Ada"), ("org", "")] if t else [])
    guarded = enrich.guard(found, sources)
    assert [r["reject_reason"] for r in guarded.orderBy("pos").collect()] == [None, "repeated", None, "not in the text", "unknown kind", "empty"]
    chunks = spark.createDataFrame([(10, 1, "Ada Lovelace wrote to ada."), (11, 1, "Spark runs.")], "chunk_id long, source_id long, text string")
    links = enrich.attribute(guarded, chunks)
    assert sorted((r["chunk_id"], r["value"], r["count"]) for r in links.collect()) == [(10, "ada", 2), (11, "spark", 1)]
    assert enrich.rollback(links, "llm").count() == 0
    assert {r["outcome"]: r["n"] for r in enrich.rates(guarded).collect()}["accepted"] == 2


def test_replies_are_typed(spark):
    from marlstone.operators import enrich

    replies = [(1, '{"entities": [{"kind": "org", "value": "Mill"}, {"value": "x", "more": 1}], "links": [{"target": "b", "evidence": "see b"}]}'), (2, "no json"), (3, None), (4, "{}"), (5, '[{"kind": "org"}]'), (6, '{"entities": "many"}'), (7, ' {"entities": [], "odd": [1]}'), (8, "")]
    entities, links, failed = (df.collect() for df in enrich.typed(spark.createDataFrame(replies, "source_id long, reply string")))
    assert sorted((r["source_id"], r["pos"], r["kind"], r["value"]) for r in entities) == [(1, 0, "org", "Mill"), (1, 1, None, "x")]
    assert [tuple(r) for r in links] == [(1, 0, "b", "see b")] and sorted(r["source_id"] for r in failed) == [2, 3, 5, 6, 8]


def test_communities_hang_together():
    import random

    from marlstone.functions import community

    assert community.connected({(0, 1): 1.0}, [0, 0, 1]) and not community.connected({(0, 1): 1.0}, [0, 0, 0]) and not community.connected({(0, 2): 1.0, (1, 2): 1.0}, [0, 0, 1])
    for seed in range(20):
        rng = random.Random(seed)
        edges = {(a, b): rng.random() for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12}
        assert community.connected(edges, community.leiden(30, edges, seed=seed))


def test_sessions(spark):
    from marlstone.operators import sessions

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(sessions.title_of(F.lit("  a  b "))) == "a b" and one(sessions.title_of(F.lit(""))) == "New Chat"
    assert one(sessions.title_of(F.lit("word " * 20))) == "word word word word word word word word…"
    assert one(sessions.artifact_type(F.lit("x.MD"))) == "markdown" and one(sessions.artifact_type(F.lit("x"))) == "text"
    assert one(sessions.safe_name(F.lit(" My: / file "))) == "My_ _ file" and one(sessions.safe_name(F.lit(" "))) == "artifact"
    tools = spark.createDataFrame([("b",), ("a",)], "name string")
    off = spark.createDataFrame([(1, "a")], "session_id int, tool_name string")
    assert [r["name"] for r in sessions.enabled_tools(tools, off, 1).collect()] == ["b"]
    old = spark.createDataFrame([(1, 4)], "session_id int, seq int")
    new = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "session_id int, pos int, content string")
    assert {r["content"]: r["seq"] for r in sessions.with_sequence(old, new).collect()} == {"x": 5, "y": 6, "z": 1}
    skills = spark.createDataFrame([("Make", "Tea"), ("other", "coffee")], "name string, description string")
    assert [r["name"] for r in sessions.find_skills(skills, "TEA").collect()] == ["Make"]


def small_store(spark):
    text = {1: "Alpha Mill stands by the river", 2: "see [[b]] and Alpha Mill", 3: "closing words here", 4: "Alpha Mill again in b", 5: "more of b", 6: "talk of Alpha Mill"}
    of = {1: "a", 2: "a", 3: "a", 4: "b", 5: "b", 6: "c"}
    vector = {1: [1.0, 0.0, 0.1], 2: [0.2, 1.0, 0.0], 4: [1.0, 0.05, 0.1], 5: [0.1, 1.0, 0.1], 6: [0.0, 0.1, 1.0]}
    ord_ = {1: 1, 2: 2, 3: 4, 4: 1, 5: 2, 6: 1}
    chunks = spark.createDataFrame([(f"k{i}", of[i], ord_[i], t, 5, vector.get(i), "") for i, t in text.items()], "chunk_id string, source_id string, ord long, text string, token_count long, embedding array<double>, heading_path string")
    sources = spark.createDataFrame([(s, "directory" if s != "c" else "conversation", s, None if s != "c" else "9", "", "h", 10, "pending") for s in "abc"], "source_id string, source_type string, source_ref string, session_id string, title string, content_hash string, token_count long, entity_pass string")
    links = spark.createDataFrame([("a", "b", "", "[[b]]", False, "link", 1), ("b", "a", "", "again in b", False, "link_inferred", 1)], "from_ref string, to_ref string, heading string, raw string, embed boolean, kind string, pos int")
    from marlstone.operators import entities

    return {"sources": sources, "chunks": chunks, "links": links, "entities": entities.entity_counts(chunks, "chunk_id")}


def test_edges_are_built_and_updated(spark):
    from marlstone.operators import build, store

    s = small_store(spark)
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", "kind", F.round("weight", 4)).collect()))
    whole = cut(build.build_edges(s["sources"], s["chunks"], s["links"], s["entities"]))
    kinds = {(a, b, k) for a, b, k, _ in rows(whole)}
    assert {("k1", "k2", "next"), ("k2", "k1", "prev"), ("k2", "k4", "link"), ("k4", "k1", "link_inferred"), ("k1", "k4", "similar"), ("k4", "k1", "similar"), ("k2", "k5", "similar")} <= kinds
    assert ("k2", "k3", "next") not in kinds and not any("k6" in (a, b) for a, b, k in kinds if k == "similar") and ("k1", "k4", "entity") in kinds
    changed = spark.createDataFrame([("b",)], "source_id string")
    # Nothing changed but the chunks' identity: a full and a scoped build agree.
    assert rows(build.update_edges(whole, s["sources"], s["chunks"], s["links"], s["entities"], changed)) == rows(whole)
    # A note that is made anew loses its edges and gets them back, those of other notes into it included.
    again = s["chunks"].withColumn("chunk_id", F.when(F.col("source_id") == "b", F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")))
    from marlstone.operators import entities

    named = entities.entity_counts(again, "chunk_id")
    assert rows(build.update_edges(whole, s["sources"], again, s["links"], named, changed)) == rows(build.build_edges(s["sources"], again, s["links"], named))
    assert rows(build.build_edges(s["sources"], s["chunks"], None, s["entities"], whole)) == rows(whole)
    gone = store.drop_sources(s | {"edges": whole, "terms": s["chunks"].select("chunk_id", F.lit("t").alias("term"))}, changed)
    assert not any(x in ("k4", "k5") for a, b, *_ in rows(gone["edges"]) for x in (a, b)) and gone["terms"].count() == 4


def test_store_defaults_and_conditions(spark):
    from marlstone.operators import store

    new = spark.createDataFrame([("", None, "2024-01-02", None), ("x", "Mine", "2024-01-01", True)], "session_id string, title string, created_at string, pinned boolean")
    out = {r["title"]: r for r in store.with_defaults(new).collect()}
    assert out["New Chat"]["session_id"] and out["New Chat"]["pinned"] is False and out["Mine"]["session_id"] == "x"
    assert [r["pinned"] for r in store.set_where(new, "session_id = 'x'", pinned=False).collect()] == [None, False]
    made = store.artifact_defaults(spark.createDataFrame([(None, ""), ("T", "sql")], "title string, content_type string"))
    assert sorted(map(tuple, made.collect())) == [("T", "sql"), ("Untitled", "text")]
    links = spark.createDataFrame([("c", "k", "v", 1, "h")], "chunk_id string, kind string, value string, count int, extractor string")
    more = spark.createDataFrame([("c", "k", "v", 3, "llm"), ("c", "k", "w", 2, "llm")], links.schema)
    assert sorted(r["count"] for r in store.add_entities(links, more).collect()) == [1, 2] and sorted(r["count"] for r in store.add_entities(links, more, additive=False).collect()) == [2, 3]
    assert store.drop_links(small_store(spark)["links"], spark.createDataFrame([("a",)], "from_ref string")).count() == 1


def test_folders_of_skills_and_modes(spark, tmp_path):
    root = str(tmp_path)
    files.write_text(root, "deep/SKILL.md", "---\nname: zeta\ndescription: a: b\n---\n\n# Body\n")
    files.write_text(root, "plain.md", "no head")
    files.write_text(root, "other/readme.md", "not a skill")
    assert files.save_skill(root, "My  Skill!", "does\nthings", " body ") == "my-skill.md"
    with pytest.raises(ValueError):
        files.save_skill(root, "my skill", "again", "body")
    got = [tuple(r) for r in files.skills(spark, root).select("name", "description", "ref").collect()]
    assert got == [("My Skill!", "does things", "my-skill.md"), ("plain", "", "plain.md"), ("zeta", "a: b", "deep/SKILL.md")]
    assert [r["body"] for r in files.skill_body(files.skills(spark, root), "zeta").collect()] == ["# Body\n"]
    (tmp_path / "cot").mkdir()
    for name, text in (("b.md", "---\nmax_tokens: 64\n---\nthink"), ("a.md", "---\nmax_tokens: many\n---\n"), ("c.md", "---\nopen: end\nthink")):
        files.write_text(root, f"cot/{name}", text)
    assert [tuple(r) for r in files.modes(spark, f"{root}/cot").collect()] == [("a", 1024, ""), ("b", 64, "think"), ("c", 1024, "---\nopen: end\nthink")]
    assert files.list_folder(root, "deep") == [("SKILL.md", False, 45)] and files.read_text(root, "plain.md") == "no head"
    files.write_text(root, "big.txt", "x" * (files.MAX_READ + 1))
    with pytest.raises(ValueError):
        files.read_text(root, "big.txt")


def test_note_metadata_and_other_sources(spark):
    from marlstone.operators import ingest

    notes = spark.createDataFrame([("d/2024-05-06 Plan.md", "---\ntitle: Mine\ntags: [A, '#b', a]\ncreated: 2023-01-02T10:00\naliases: [x]\n---\ntext #c #a"), ("n.md", "plain"), ("20231301.md", None)], "ref string, text string")
    out = {r["ref"]: tuple(r)[1:] for r in ingest.note_metadata(notes).collect()}
    assert out == {"d/2024-05-06 Plan.md": ("Mine", ["c", "a", "b"], ["2024-05-06", "2023-01-02"], ["x"]), "n.md": ("n", [], [], []), "20231301.md": ("20231301", [], [], [])}
    arts = spark.createDataFrame([("1", "Plan", "markdown", "# Back\n\nroll it"), ("2", "", "text", "words"), ("3", "T", "sql", "  ")], "artifact_id string, title string, content_type string, content string")
    assert sorted((r["artifact_id"], r["heading_path"]) for r in ingest.artifact_chunks(arts).collect()) == [("1", "Plan (markdown) › Back"), ("2", "Untitled artifact")]
    rows = [(1, 1, "user", "hi Corin Mill", None), (1, 2, "cot", "secret Hidden Name", None), (1, 3, "assistant", "yo", None)]
    pairs = conversation.turn_pairs(spark.createDataFrame(rows, "session_id long, seq int, role string, content string, tool_name string"))
    turn = ingest.turn_chunks(pairs, F.lit("Thread")).first()
    assert "secret" in turn["terms"] and "thread" in turn["terms"] and "cot" not in turn.asDict()
    assert turn["heading_path"] == "Thread › turn 1"
    assert "hidden name" not in {e["value"] for e in turn["entities"]} and "corin mill" in {e["value"] for e in turn["entities"]}


def test_near_copies_are_rejected_on_the_way_in(spark):
    from marlstone.operators import ingest

    base = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven grey herons watch"
    new = spark.createDataFrame([("a", 1, base), ("a", 2, "something else entirely stands here"), ("a", 3, "something else entirely stands here."), ("b", 1, base + "!"), ("a", 4, "")], "ref string, ord long, text string")
    stored = spark.createDataFrame([("a", "something else entirely stands here"), ("c", base.replace("seven", "eight")), ("d", "far away words")], "ref string, text string")
    out = {(r["ref"], r["ord"]): r["near_copy"] for r in ingest.reject_near_copies(new, stored).collect()}
    assert out == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): True, ("a", 4): False}


def test_folder_is_ingested_and_brought_up_to_date(spark, tmp_path):
    from marlstone.operators import ingest

    (tmp_path / "sub").mkdir()
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("a.md", "# A\n\nCorin Mill stands by the river bank and turns slowly. See [[b]].\n\n## Part\n\nMore about the wheel and its long history here.")
    write("sub/b.md", "---\naliases: [bee]\n---\nThe second note speaks of Corin Mill and of nothing much besides that.")
    start = {"sources": small_store(spark)["sources"].limit(0), "chunks": small_store(spark)["chunks"].drop("heading_path").withColumn("embedding", F.col("embedding").cast("array<float>")).limit(0)}
    empty = lambda ddl: spark.createDataFrame([], ddl)
    start |= {"chunks": start["chunks"].withColumn("heading_path", F.lit("")).limit(0), "terms": empty("chunk_id string, term string, tf long"), "entities": empty("chunk_id string, kind string, value string, count long, extractor string"), "links": empty("from_ref string, to_ref string, heading string, raw string, embed boolean, kind string"), "edges": empty("src string, dst string, kind string, weight double")}
    one, report = ingest.ingest_folder(spark, str(tmp_path), start)
    assert {r["action"]: r["n"] for r in report.collect()} == {"added": 2} and one["sources"].count() == 2 and one["chunks"].filter("embedding is null").count() == 0
    name = {r["chunk_id"]: r["text"][:10] for r in one["chunks"].collect()}
    kinds = {(name[r["src"]], name[r["dst"]], r["kind"]) for r in one["edges"].collect()}
    assert ("# A\n\nCorin", "The second", "link") in kinds and ("The second", "# A\n\nCorin", "entity") in kinds and any(k == "next" for *_, k in kinds)
    two, report = ingest.ingest_folder(spark, str(tmp_path), one)
    assert {r["action"]: r["n"] for r in report.collect()} == {"touched": 2} and two["edges"].count() == one["edges"].count() and two["terms"].count() == one["terms"].count()
    write("sub/b.md", "A wholly different note that still speaks of Corin Mill in passing.")
    write("c.md", "The third one links to [[sub/b|it]].")
    (tmp_path / "a.md").unlink()
    three, report = ingest.ingest_folder(spark, str(tmp_path), two)
    assert {r["action"]: r["n"] for r in report.collect()} == {"added": 1, "changed": 1, "removed": 1}
    assert {r["source_ref"] for r in three["sources"].collect()} == {"sub/b.md", "c.md"} and {r["from_ref"] for r in three["links"].collect()} == {"c.md"}
    ids = {r["chunk_id"] for r in three["chunks"].collect()}
    assert {r["chunk_id"] for r in three["terms"].collect()} == ids and all(r["src"] in ids and r["dst"] in ids for r in three["edges"].collect())
    # Its id stays with the note.
    of = lambda s: {r["source_ref"]: r["source_id"] for r in s["sources"].collect()}
    assert of(three)["sub/b.md"] == of(one)["sub/b.md"]


def test_history_is_ingested_once(spark):
    from marlstone.operators import history

    empty = lambda ddl: spark.createDataFrame([], ddl)
    base = small_store(spark)
    said = [("1", 1, "user", "hi Corin Mill", None), ("1", 2, "cot", " ".join(f"secret{i}" for i in range(80)), None), ("1", 3, "assistant", "# Plan\n\nyes, Corin Mill", None), ("1", 4, "user", "and then?", None), ("1", 5, "assistant", "", None), ("2", 1, "user", "other", None), ("2", 2, "assistant", "reply", None), ("9", 1, "user", "lost", None), ("9", 2, "assistant", "session unknown", None)]
    known = {"sources": base["sources"].limit(0), "chunks": base["chunks"].withColumn("embedding", F.col("embedding").cast("array<float>")).limit(0), "terms": empty("chunk_id string, term string, tf long"), "entities": empty("chunk_id string, kind string, value string, count long, extractor string"), "links": empty("from_ref string, to_ref string, heading string, raw string, embed boolean, kind string"), "edges": empty("src string, dst string, kind string, weight double")}
    known["messages"] = spark.createDataFrame(said, "session_id string, seq int, role string, content string, tool_name string")
    known["sessions"] = spark.createDataFrame([("1", "Mills"), ("2", None)], "session_id string, title string")
    kept = [("a1", "1", "Sketch", "markdown", "# Wheel\n\nCorin Mill turns"), ("a2", "2", "", "text", "  "), ("a3", "2", None, None, "plain words")]
    known["artifacts"] = spark.createDataFrame(kept, "artifact_id string, session_id string, title string, content_type string, content string")
    counts = lambda report: {(r["source_type"], r["action"]): r["n"] for r in report.collect()}
    one, report = history.ingest_history(known)
    assert counts(report) == {("conversation", "added"): 2, ("conversation", "no reply"): 1, ("artifact", "added"): 2}
    assert {(r["source_ref"], r["title"], r["session_id"]) for r in one["sources"].collect()} == {("1#1-3", "Mills", "1"), ("2#1-2", "", "2"), ("a1", "Sketch", "1"), ("a3", "Untitled artifact", "2")}
    paths = {r["heading_path"] for r in one["chunks"].collect()}
    assert {"Sketch (markdown) › Wheel", "Untitled artifact", "Conversation › turn 1"} <= paths and any(p.startswith("Mills › turn 1") for p in paths)
    assert one["chunks"].filter("embedding is null").count() == 0 and {r["value"] for r in one["entities"].collect()} >= {"corin mill"}
    words = {r["term"] for r in one["terms"].collect()}
    assert {"secret0", "secret63", "turns"} <= words and "secret64" not in words and "lost" not in words
    assert one["edges"].filter("kind = 'entity'").count() > 0
    two, report = history.ingest_history(known | one)
    assert counts(report) == {("conversation", "unchanged"): 2, ("conversation", "no reply"): 1, ("artifact", "unchanged"): 2}
    for name in ("sources", "chunks", "terms", "entities", "edges"):
        assert two[name].count() == one[name].count()
    changed = two | {"artifacts": known["artifacts"].withColumn("content", F.when(F.col("artifact_id") == "a3", "new words").otherwise(F.col("content")))}
    three, report = history.ingest_history(changed)
    assert counts(report)["artifact", "changed"] == 1 and "plain" not in {r["term"] for r in three["terms"].collect()} and three["chunks"].count() == one["chunks"].count()


def test_queries_scored_together_equal_queries_alone(spark):
    from marlstone.operators import retrieval

    docs = spark.createDataFrame([(i, f"word{i % 5} common tea{i}" * (1 + i % 3)) for i in range(30)] + [(30, None), (31, "")], "doc_id long, text string")
    asked = [(1, "common tea7 word3"), (2, ""), (3, None), (4, "word1 word2 word2"), (5, "unheard")]
    got = retrieval.bm25_many(docs, spark.createDataFrame(asked, "query_id long, text string"), 4).orderBy("query_id", "rank").collect()
    for i, text in asked:
        alone = retrieval.bm25(docs, spark.createDataFrame([(text or "",)], "text string"), 4).collect()
        assert [(r["doc_id"], r["score"]) for r in got if r["query_id"] == i] == [(r["doc_id"], round(r["score"], 6)) for r in alone]
    assert {r["query_id"] for r in got} == {1, 4}


def test_index_answers_as_the_texts_do_and_is_kept_up(spark, tmp_path):
    from marlstone.operators import index, retrieval

    rows = {i: f"word{i % 5} common tea{i} Corin Mill{i % 3}" for i in range(40)} | {40: None, 41: ""}
    frame = lambda d: spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in d.items()], "doc_id long, text string, source string")
    asked = spark.createDataFrame([("common tea7 word3 Corin Mill1",)], "text string")
    kept = index.build(frame(rows), str(tmp_path / "ix"), parts=4)

    def same(now):
        want, got = ({(r["doc_id"], round(r["score"], 6)) for r in df.collect()} for df in (retrieval.bm25(frame(now), asked, None), index.bm25(kept, asked, None)))
        assert want == got and len(want) > 5
        want, got = ({(r["doc_id"], r["entity"]) for r in df.collect()} for df in (search.entity_signal(frame(now), asked), index.entity_signal(kept, asked)))
        assert want == got and want
        assert {(r["doc_id"], r["text"]) for r in index.texts(kept, [0, 7, 40, 99]).collect()} == {(i, now[i] or "") for i in (0, 7, 40, 99) if i in now}

    same(rows)
    changed = {7: "nothing left of it", 60: "tea7 common anew", 0: "common common"}
    index.update(kept, frame(changed), spark.createDataFrame([(3,), (12,)], "doc_id long"))
    now = {i: t for i, t in (rows | changed).items() if i not in (3, 12)}
    same(now)
    index.update(kept, frame({3: "word3 is back"}), spark.createDataFrame([(60,)], "doc_id long"))
    same({i: t for i, t in (now | {3: "word3 is back"}).items() if i != 60})
    plan = index.bm25(kept, asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters", 1)[1][:200]


def test_search_filters_and_report(spark):
    rows = [(1, "alpha beta", "a", "s1", "2024-01-05"), (2, "alpha two", "b", "s2", "2024-02-05"), (3, "alpha three", "c", None, None), (4, "alpha four", "d", "s2", "2024-03-05"), (5, "unlike", "e", "s1", "2024-01-01")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, session_id string, ingested_at string")
    asked = spark.createDataFrame([("alpha",)], "text string")
    run = lambda **o: {r["doc_id"] for r in search.search(docs, None, asked, None, options=search.Options(**o)).collect()}
    assert run() == {1, 2, 3, 4} and run(exclude_session="s2") == {1, 3} and run(since="2024-02-01") == {2, 3, 4} and run(until="2024-02-05") == {1, 2, 3} and run(since="2024-02-01", until="2024-02-28") == {2, 3}
    edges = spark.createDataFrame([(1, 5, "link", 1.0), (5, 9, "next", 1.0)], "src long, dst long, kind string, weight double")
    found = search.explain(docs, None, asked, None, edges, search.Options(since="2024-01-01"), no_vectors="no model")
    assert tuple(found.report.first()) == (4, 4, 1, 5, "no model")
    told = {r["doc_id"]: r for r in found.explained.collect()}
    assert (told[5]["hops"], told[5]["via"], told[5]["bm25"]) == (1, "link", 0.0) and told[1]["hops"] is None and told[1]["bm25"] > 0
    text = search.rendered(found, docs).first()["text"]
    assert text.startswith("4 result(s)") or text.startswith("5 result(s)")
    assert "Searched without vectors: no model" in text and "[1] " in text and "found over a written link, 1 step(s)" in text and "\nunlike" in text.replace("\n\n", "\n")
    none = search.rendered(search.explain(docs, None, spark.createDataFrame([("omega",)], "text string"), None), docs).first()["text"]
    assert none == "Nothing shares a word with the query.\nSearched without vectors: no vectors given"
    barred = search.rendered(search.explain(docs, None, asked, None, options=search.Options(since="2099", source_types=["zz"])), docs).first()["text"]
    assert barred.startswith("4 candidates, none of which passed")
    # What a filter rejects the walk doesn't bring back.
    assert 5 not in {r["doc_id"] for r in search.search(docs, None, asked, None, edges, search.Options(since="2024-01-02")).collect()}


@needs_tables
def test_fused_search_is_that_of_plain_python(spark, duck):
    sql = f"WITH {catalog._FUSED} SELECT f.doc_id, f.source, f.fused, coalesce(d.text, '') AS text, {catalog._tokens(catalog._TEXT)} AS token_count FROM fused f JOIN documents d USING (doc_id)"
    pool = {r[0]: r for r in duck.execute(sql).fetchall()}
    texts = {r[0]: r for r in duck.execute(f"SELECT doc_id, source, 0.0, coalesce(text, ''), {catalog._tokens(catalog._TEXT)} FROM documents").fetchall()}
    edges = duck.execute(f"WITH {catalog._SIMILAR} SELECT a.src, a.dst, a.similarity FROM similar_ a JOIN similar_ b ON a.src = b.dst AND a.dst = b.src").fetchall()

    def results(score):
        best = {}
        for i, s in sorted(score.items()):
            source = texts[i][1]
            if source not in best or round(s, 6) > round(score[best[source]], 6):
                best[source] = i
        grams = lambda t: {x[i : i + 3] for i in range(len(x) - 2)} if len(x := " ".join(t.lower().split())) >= 3 else {x} - {""}
        taken, used = [], 0
        for i in sorted(best.values(), key=lambda i: (-score[i], i)):
            alike = any(2 * len(grams(texts[i][3]) & grams(texts[j][3])) >= 0.85 * (len(grams(texts[i][3])) + len(grams(texts[j][3]))) for j in taken)
            if len(taken) < 6 and not alike and (not taken or used + texts[i][4] <= 2000):
                taken.append(i)
                used += texts[i][4]
        return taken

    score = {i: r[2] for i, r in pool.items()}
    ids = lambda name: [r["doc_id"] for r in catalog.QUERIES[name](spark, SF).orderBy("rank").collect()]
    assert ids("fused_search") == results(score) == ids("fused_search_indexed")
    front = dict(sorted(((i, s) for i, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:10])
    seen, walked = set(front), {}
    for _ in range(2):
        reached = {}
        for a, b, w in edges:
            if a in front and b not in seen and front[a] * w * 0.4 >= 1e-4:
                reached[b] = max(reached.get(b, 0.0), front[a] * w * 0.4)
        front = dict(sorted(reached.items(), key=lambda x: (-x[1], x[0]))[:30])
        seen |= set(front)
        walked |= front
    for i, s in walked.items():
        score[i] = score[i] + 0.25 * s if i in score else s
    assert ids("fused_search_walk") == results({i: s for i, s in score.items() if i in texts})


@needs_tables
def test_near_pairs_of_a_table_match_brute_force(spark, duck):
    import re

    rows = {}
    for i, t in sorted(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()):
        rows.setdefault(t, i)
    grams, terms, probes = {}, {}, {}
    for t, i in rows.items():
        x = re.sub(r"\s+", " ", t.lower()).strip(" ")
        grams[i] = {x[k : k + 3] for k in range(len(x) - 2)} if len(x) >= 3 else {x} - {""}
    for r in dedup.term_freq(catalog.docs(spark, SF)).filter("octet_length(term) >= 4").collect():
        terms.setdefault(r["doc_id"], []).append((r["tf"], r["term"]))
    for i in grams:
        probes[i] = {w for _, w in sorted(terms.get(i, []))[:6]}
    words = {i: {w for _, w in terms.get(i, [])} for i in grams}
    want = {}
    for i in grams:
        for j in grams:
            if i < j and (probes[i] & words[j] or probes[j] & words[i]):
                d = 2 * len(grams[i] & grams[j]) / (len(grams[i]) + len(grams[j]))
                if d >= 0.85:
                    want[i, j] = round(d, 6)
    got = {(r["a"], r["b"]): r["dice"] for r in catalog.QUERIES["dice_pairs"](spark, SF).collect()}
    assert got == want and len(want) > 5


def _alike(n: int) -> list[tuple[int, str]]:
    """Long texts of few words: most share nearly all trigrams, and each has a word of its own."""
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("nd", "rt", "ss") for c in ("er", "al", "on", "um")]
    return [(i, " ".join(words[(i * k + k * k // 3) % len(words)] for k in range(1, 160)) + f" own{i:05d}") for i in range(n)]


def test_near_pairs_that_are_many_equal_brute_force_and_meet_in_tiles(spark, monkeypatch):
    """Nothing is paired up in a shuffle: rows that tasks exchange grow with the texts, not with the pairs."""
    rows = _alike(120) + [(1000 + i, f"short text {i}") for i in range(40)]
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in rows}
    count = {i: pd.Series([w for w in t.split() if len(w) >= 4]).value_counts() for i, t in rows}
    probes = {i: {w for _, w in sorted((n, w) for w, n in c.items())[:6]} for i, c in count.items()}
    want = {}
    for i, _ in rows:
        for j, _ in rows:
            if i < j and (probes[i] & set(count[j].index) or probes[j] & set(count[i].index)):
                d = 2 * len(grams[i] & grams[j]) / (len(grams[i]) + len(grams[j]))
                if d >= 0.85:
                    want[i, j] = d
    monkeypatch.setattr(dedup, "TILE_BYTES", 100_000)
    monkeypatch.setattr(dedup, "LANES", 160)
    monkeypatch.setattr(dedup, "ROWS", 7)
    met = []
    monkeypatch.setattr(dedup, "meet", lambda left, right, lanes, order: met.append(lanes) or tiles.meet(left, right, lanes, order))
    got = {(r["a"], r["b"]): r["dice"] for r in dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) > 200
    assert sum(map(len, met)) > 3


def _nearest_by_force(rows, k, least):
    """(src, dst, similarity) as the SQL has it, in plain Python over (id, label, vector)."""
    want = set()
    for i, a, x in rows:
        sims = []
        for j, b, y in rows:
            if a != b:
                d, size = min(len(x), len(y)), (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
                sims.append((-round(sum(p * q for p, q in zip(x[:d], y[:d], strict=True)) / size if size else 0.0, 6), j))
        want |= {(i, j, -s) for s, j in sorted(sims)[:k] if -s >= least}
    return want


@pytest.mark.parametrize("least", [0.25, -2.0])
def test_nearest_vectors_over_many_tiles_equal_brute_force_and_leave_tasks_reduced(spark, monkeypatch, least):
    """Copies, zeros, ties and other lengths; a lane gives no more than ``k`` rows for each vector."""
    import random

    from marlstone.operators import retrieval

    rng = random.Random(5)
    base = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(40)]
    rows = [(7 * i + 1, rng.randint(0, 3), base[i % 40] if i % 3 else [rng.random() - 0.3 for _ in range(6)]) for i in range(150)]
    rows += [(5000, 1, [0.0] * 6), (5001, 2, base[1][:4]), (5002, 2, base[2] + [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    extra = spark.createDataFrame([(9000, 1, None), (9001, None, base[0])], table.schema)
    lanes = []
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "meet", lambda left, right, pairs, order: lanes.append((pairs, left, right)) or tiles.meet(left, right, pairs, order))
    got = retrieval.similar_topk(table.unionByName(extra), 8, least)
    want = _nearest_by_force(rows, 8, least)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200
    (pairs, left, right), = lanes
    parts = 1 + max(p for _, p in pairs)
    assert len(pairs) > 16 and parts > 2
    met = tiles.meet(left, right, pairs, ["vec_id"]).mapInArrow(retrieval._nearest(8, least), "src long, dst long, similarity double")
    assert met.count() <= 8 * len(rows) * parts
    asked = table.filter("vec_id % 5 = 0")
    ids = {r["vec_id"] for r in asked.collect()}
    assert {tuple(r) for r in retrieval.similar_topk(table, 8, least, asked).collect()} == {w for w in want if w[0] in ids}


def test_similar_chunks_read_the_chunks_once(spark):
    from marlstone.operators import build

    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"c{i}", f"s{i % 4}", [1.0, float(i % 5), float(i % 3)]) for i in range(30)]
    schema = "chunk_id string, source_id string, embedding array<double>"
    chunks = spark.createDataFrame(rows, schema).mapInArrow(pass_on, schema)
    changed = spark.createDataFrame([("c3",), ("c8",)], "chunk_id string")
    whole = {tuple(r) for r in build.similar(chunks, least=0.3).collect()}
    assert seen.value == 30
    scoped = {tuple(r) for r in build.similar(chunks, changed, least=0.3).collect()}
    assert seen.value == 60 and scoped == {r for r in whole if {"c3", "c8"} & {r[0], r[1]}}


def test_guarded_links_carry_no_text_beyond_the_first_join(spark):
    from marlstone.operators import build

    sources = spark.createDataFrame([("s1", "a.md", "some Words here"), ("s2", "b.md", None)], "source_id string, source_ref string, text string")
    proposed = spark.createDataFrame([("s1", 0, "B", "words"), ("s1", 1, "B", "here"), ("s1", 2, "A", "some"), ("s2", 0, "A", "words")], "source_id string, pos int, target string, evidence string")
    out = build.guard_links(proposed, sources, spark.createDataFrame([("A", "a.md"), ("B", "b.md")], "target string, to_ref string"))
    assert {(r["source_id"], r["pos"], r["reject_reason"]) for r in out.collect()} == {("s1", 0, None), ("s1", 1, "repeated"), ("s1", 2, "itself"), ("s2", 0, "no evidence")}

    def joins(node):
        if node.nodeName() == "Join":
            for i in range(2):
                columns = node.children().apply(i).output()
                yield any(columns.apply(c).name() in ("low", "text") for c in range(columns.size()))
        for i in range(node.children().size()):
            yield from joins(node.children().apply(i))

    assert list(joins(out._jdf.queryExecution().optimizedPlan())).count(True) == 1


def test_entity_edges_find_the_entities_of_a_text_once(spark):
    from marlstone.operators import entities

    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "doc_id long, source string, kind string, value string"
    links = spark.createDataFrame([(i, f"s{i % 3}", "proper", f"v{i // 2}") for i in range(12)], schema).mapInArrow(pass_on, schema)
    assert len(entities.entity_edges(links, spark.range(12).selectExpr("count(*) as n"), source_col="source").collect()) == 12
    assert seen.value == 12


def test_text_patterns_cut_and_find_what_longer_ones_did(spark):
    """The patterns as they were before searching was made cheaper, and one search for code in a text."""
    from pyspark.sql import functions as F

    from marlstone.functions import text as X

    odd = ["a.b- x/y_ _z é.É Élan Ab. ÀB Hill Top 2024-01-02 x2024-01-02 Jan 3, 2024 aJan 3 2024 5ms 5 % $3 x$3.5 €7,0 a/b c.py .md d.mdx /e f", "", "-- . /", "`Code A` Out ~~~ In", "x.y.z-- w.go/ 1.5kb 12.em"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, None])], "i int, t string")
    before = {
        "ISO_DATE": X.EDGE + r"([0-9]{4}-[0-9]{2}-[0-9]{2})" + X.EDGE,
        "PROPER": X.EDGE + r"(\p{Lu}[\p{L}0-9]*(?:[ \t]+\p{Lu}[\p{L}0-9]*)*)" + X.EDGE,
        "NUMBER": r"([$€£][\t\n\f\r ]?[0-9][0-9,]*(?:\.[0-9]+)?|" + X.EDGE + r"[0-9][0-9,]*(?:\.[0-9]+)?[\t\n\f\r ]?(?:%|ms|s|kb|mb|gb|tb|px|em|rem)" + X.EDGE + ")",
    }
    for name, pattern in before.items():
        found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(1))
        assert rows.filter(~found(pattern).eqNullSafe(found(getattr(X, name)))).count() == 0, name
        assert getattr(X, name).startswith("(?="), name
    ends = F.filter(F.transform(F.regexp_extract_all("t", F.lit(X.WORD), F.lit(0)), lambda w: F.regexp_replace(w, r"^[._/-]+|[._/-]+$", "")), lambda w: w != "")
    assert rows.filter(~ends.eqNullSafe(X.words(F.col("t")))).count() == 0
    plan = rows.select(X.entity_array(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("~~~") < 6


def test_hashed_vectors_look_each_feature_up_once(monkeypatch):
    import numpy as np

    from marlstone.functions import embedding

    text = "tea and tea and cake " * 50
    asked, whole = [], embedding.feature_hash
    x, v = " ".join(text.split()), np.zeros(384)
    for name, weight in [(f"w:{w}", 1.0) for w in x.split()] + [(f"t:{x[i : i + 3]}", 0.5) for i in range(len(x) - 2)]:
        h = whole(name)
        v[h % 384] += -weight if h >> 40 & 1 else weight
    monkeypatch.setattr(embedding, "feature_hash", lambda f: asked.append(f) or whole(f))
    assert embedding.embed(text) == (v / np.linalg.norm(v)).astype(np.float32).tolist()
    assert len(asked) == len(set(asked)) < 40
