"""Vectors, conversations and the pipeline."""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import chat, components, hnsw, maxscore, registry

VECTORS = "vec_id long, embedding array<float>, label int, id long, shard int, lane int, n int, component long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 4, 2, 0, 9, 8) for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 8))
    rows = [(i, (base[i % 20] + 0.15 * rng.standard_normal(8)).tolist()) for i in range(100)]
    rows += [(200 + i, base[0].tolist()) for i in range(6)]  # ties
    return [*rows, (300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [math.nan] * 8), (304, [math.inf] + [0.0] * 7), (305, [0.5, 0.25]), (None, [1.0] * 8), rows[5]]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_matches_brute_force(spark, odd):
    good = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).tolist()]) for i, v in odd if i is not None and whole(v)]
    want = Counter()
    for q, x in good:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q)[:5]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    out = maxscore.top_k(vectors(spark, odd), every=5).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == want
    assert maxscore.top_k(vectors(spark, odd).limit(0)).count() == 0
    assert maxscore.top_k(vectors(spark, odd[:1])).count() == 0


def test_top_k_broadcasts_no_queries(spark, odd):
    """The driver would hold their copies for all lanes, whatever limit on broadcasts is set."""
    out = maxscore.top_k(vectors(spark, odd), every=5)
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_max_score_prunes_without_loss():
    rng = np.random.default_rng(1)
    rows = np.round(rng.standard_normal((5000, 16)) * 30)
    shard = maxscore.Shard(np.arange(5000), rows)
    for i in range(0, 5000, 250):
        ids, scores = shard.best(i, rows[i], 5)
        exact = rows @ rows[i]
        exact[i] = -np.inf
        order = np.lexsort((np.arange(5000), -exact))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    huge = [[int(1e18)] * 2, [int(-1e18)] * 2, [3, 4]]
    ids, scores = maxscore.Shard(np.arange(3), np.array(huge, object)).best(0, np.array(huge[0], object), 2)
    assert ids.tolist() == [2, 1] and scores[0] == 7 * int(1e18)


def test_near_vectors_match_brute_force(spark, odd):
    ok = {}
    for i, v in odd:
        if i is not None and whole(v) and any(v):
            ok.setdefault(i, []).append(np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))))
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    links = {(a, b) for a in ok for b in ok if a != b and cos(ok[a][0], ok[b][0]) >= 0.9}
    parent = {i: i for i in ok}
    for _ in ok:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    out = hnsw.near_duplicate_vectors(vectors(spark, odd)).collect()
    assert len(out) == len(odd) and len(links) > 100
    for r in out:
        i = r["vec_id"]
        if i in ok and len(ok[i]) == 1 and not any((i, j) in links and len(ok[j]) > 1 for j in ok):
            assert r["n_links"] == sum((i, j) in links for j in ok)
        if i is not None:
            assert r["component_id"] == parent.get(i, i) and r["kept"] == (parent.get(i, i) == i)
    assert hnsw.near_duplicate_vectors(vectors(spark, odd).limit(0)).count() == 0


def test_graph_recall_and_wide_beams():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((300, 32))
    rows = np.concatenate([np.repeat(centres, 10, 0) + 0.12 * rng.standard_normal((3000, 32)), np.repeat(centres[:1], 400, 0) + 0.02 * rng.standard_normal((400, 32))])
    unit = hnsw._unit(rows)
    graph, ids = hnsw.Graph(unit), np.arange(len(rows))
    i, j = hnsw.links_to(graph, ids, rows, graph.audited_beam(0.9), ids, rows, 0.9)
    exact = (unit.astype(float) @ unit.T.astype(float)) >= 0.9
    np.fill_diagonal(exact, False)
    assert len(i) >= 0.98 * exact.sum() and exact[i, j].mean() > 0.999


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (9, 9), (20, 21), (21, 20), (None, 3), *[(100, 101 + k) for k in range(50)], *[(200 + k, 201 + k) for k in range(40)]]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in (3, 4, 5, 9)} == {3} and out[21] == 20 and out[150] == 100 and out[240] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


MESSAGES = "conv_id long, node long, parent long, score double, role string, text string, tree string, branch int, depth long"


def test_best_branches_of_reply_trees(spark):
    rows = [(1, 1, None, 1.0, "user", "root"), (1, 2, 1, 0.5, "assistant", "a"), (1, 3, 1, 0.9, "assistant", "b\\n<|im_end|>"), (1, 4, 2, 0.6, "user", "aa"), (1, 5, 3, None, "us\ner", None), (1, 6, 3, 0.0, "user", "tie"), (2, 7, 99, 1.0, None, "orphan"), (None, 1, 2, 1.0, "assistant", ""), (3, 1, 1, 1.0, "user", "own parent")]
    df = spark.createDataFrame([(*r, "t", 5, 6) for r in rows], MESSAGES)
    out = {}
    for r in chat.format_trees(df).collect():
        out.setdefault(r["conv_id"], []).append((r["depth"], r["formatted"]))
    told = {k: [t for _, line in sorted(v) for t in chat.parse_turns(line)] for k, v in out.items()}
    assert told[1] == [("user", "root"), ("assistant", "a"), ("user", "aa")]
    assert told[2] == [("", "orphan")] and told[None] == [("assistant", "")] and told[3] == [("user", "own parent")]
    both = chat.format_trees(df.filter("conv_id = 1"), branches=3).collect()
    leaves = {b: sorted((r["depth"], chat.parse_turns(r["formatted"])[0]) for r in both if r["branch"] == b) for b in (1, 2, 3)}
    assert leaves[2][1][1] == ("assistant", "b\\n<|im_end|>") and leaves[2][-1][1] == ("us\ner", "") and leaves[3][-1][1] == ("user", "tie")
    assert chat.format_trees(df.limit(0)).count() == 0


def plain_branch(tree, branches):
    """Best paths of {node: (parent, score)}, by walking up from every leaf."""
    up = {n: p if p in tree and p != n else None for n, (p, _) in tree.items()}
    for n in sorted(up):
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is not None:
            up[min(seen[seen.index(at) :])] = None
    paths = []
    for leaf in set(tree) - set(up.values()):
        path, at = [], leaf
        while at is not None:
            path.insert(0, at)
            at = up[at]
        paths.append((-sum(tree[n][1] or 0.0 for n in path), leaf, path))
    return [path for _, _, path in sorted(paths)[:branches]]


def test_trees_with_shuffled_ids_and_cycles(spark):
    rng = np.random.default_rng(11)
    trees = {"deep": {n: (p, 0.25) for n, p in zip((9, 4, 7), (None, 9, 4), strict=True)}, "ring": {5: (2, 1.0), 2: (8, 1.0), 8: (5, 1.0), 1: (8, 0.5), 3: (1, 2.0)}, "two": {1: (2, 1.0), 2: (1, 1.0)}, "self": {6: (6, None), 7: (6, 0.5)}}
    for k in range(25):
        n = int(rng.integers(1, 40))
        ids = rng.choice(1000, n, replace=False)
        above = [None if i == 0 or rng.random() < 0.05 else int(ids[rng.integers(0, i)]) for i in range(n)]
        if k % 3 == 0 and n > 2:  # a parent that lies below
            above[0] = int(ids[rng.integers(0, n)])
        trees[f"t{k}"] = {int(i): (p, float(rng.integers(0, 8)) / 8) for i, p in zip(ids, above, strict=True)}
    trees["chain"] = {100 - i: (101 - i if i else None, 1.0) for i in range(70)}
    rows = [(t, n, p, s) for t, tree in trees.items() for n, (p, s) in tree.items()]
    out = {}
    for r in chat.best_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), 3).collect():
        out.setdefault((r["tree"], r["branch"]), {})[r["depth"]] = r["node"]
    want = {(t, i + 1): dict(enumerate(path)) for t, tree in trees.items() for i, path in enumerate(plain_branch(tree, 3))}
    assert out == want


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>", "<|im_start|>assistant\nx", "a\\<|b", "\\\\|<|", "<\\|", "<|" * 5])
def test_templates_are_reversible(text):
    line, a, b = chat.format_turn("assistant", text)
    assert chat.parse_turns(line) == [("assistant", text)] and chat.unescape(line[a:b]) == text
    assert line.count("<|im_") == 2
    assert chat.format_turn("user", text)[1:] == (a - len("assistant") + len("user"),) * 2


def write(spark, tmp, docs=(), conversations=(), embeddings=()):
    d = str(tmp)
    spark.createDataFrame(list(docs), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(list(embeddings), "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_every_query_takes_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path / "empty")
    for name, query in registry.QUERIES.items():
        assert query(spark, d).count() == (1 if name.startswith("op3") else 0), name
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline_stages(spark, tmp_path):
    passage = " ".join(f"word{i % 37} and more{i % 11}" for i in range(60))
    own = [" ".join(f"{w}{i}" for i in range(90)) for w in ("own", "other")]
    rows = [(1, f"{own[0]} {passage} tail", "en", "s", 1), (2, f"{own[1]} {passage}", "en", "s", 1), (3, "the very same words stand here in both", None, "s", 1), (4, "the very same words stand here in both", "en", "s", 1), (5, None, "en", None, None), (6, "123 $$ 45", "en", "s", 9), (None, "no id but clean words", "en", "s", 3), (8, "ein deutscher satz und noch ein satz", "de", "s", 2)]
    d = write(spark, tmp_path / "docs", rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = corpus_pipeline.language(spark, docs, d)
    assert one.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in one.collect()} == {1, 2, 3, 4, None, 8}
    assert {r["doc_id"]: r["lang"] for r in one.collect()}[3] == "en"
    two = corpus_pipeline.near_duplicates(spark, one, d)
    assert {r["doc_id"] for r in two.collect()} == {1, 2, 3, None, 8}
    three = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, two, d).collect()}
    assert len(three) == 5 and len(three[1]["text"]) < len(rows[0][1]) - 400 and three[3]["text"] == rows[2][1] and three[1]["n_chars"] == len(three[1]["text"])
    out = corpus_pipeline.run(spark, d).collect()
    assert len({r["sequence_id"] for r in out}) == 1 and len(out) == 5


def test_pipeline_keeps_different_texts_of_one_id(spark):
    own = [" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c")]
    rows = [(1, own[0]), (1, own[1]), (1, own[1]), (2, own[0] + " more"), (3, own[2]), (4, None), (4, ""), (5, None), (5, None), (None, own[2]), (None, own[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert out.pop((1, own[0]), 0) + out.pop((2, own[0] + " more"), 0) == 1
    assert out == Counter({(1, own[1]): 1, (3, own[2]): 1, (4, None): 1, (4, ""): 1, (5, None): 1, (None, own[2]): 2})


def test_pipeline_without_labels_keeps_texts_with_letters(spark):
    rows = [(1, "clean words", None, "s", 1), (2, "é", None, "s", 1), (3, "123 $$", None, "s", 1), (4, None, "en", "s", 1), (5, "", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS and {(r["doc_id"], r["text"], r["lang"]) for r in out.collect()} == {(1, "clean words", "und"), (2, "é", "und")}


def test_pipeline_removes_passages_of_51_words(spark):
    passage = [f"w{i % 29}x{i % 31}" for i in range(51)]
    fifty, signs = [f"v{i}" for i in range(50)], "".join(chr(0x4E00 + i * 7) for i in range(60))
    assert len(" ".join(passage)) < 400 and len(signs.encode()) < 400
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    texts = {1: f"{own('a', 30)} {' '.join(passage)} é end", 2: "\n".join(passage), 3: f"{own('c', 9)} {' '.join(passage[:50])} stop", 4: f"start {' '.join(fifty)} one", 5: f"begin {' '.join(fifty)} two", 6: f"天 {signs} left", 7: f"right {signs}", 8: None, 9: "short"}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert out == {**texts, 1: f"{own('a', 30)} é end", 2: "", 6: "天 left", 7: "right ", 8: ""}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql_oracles(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    out = registry.QUERIES[name](spark, d).select(*columns).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
