"""Text, Markdown, web and graph functions."""

from __future__ import annotations

import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import chunking, community, embedding, markdown, prose, web
from marlstone.functions import text as X


@pytest.mark.parametrize(
    "text,want",
    [
        ("Rain fell. Wind rose! Who knew?", ["Rain fell.", "Wind rose!", "Who knew?"]),
        ("The toll is 7.25 today. Pay here.", ["The toll is 7.25 today.", "Pay here."]),
        ("Prof. Okoye and K. Brandt spoke. All listened.", ["Prof. Okoye and K. Brandt spoke.", "All listened."]),
        ('She wrote "enough!" Nobody replied.', ['She wrote "enough!"', "Nobody replied."]),
        ("hm ... maybe later. Stop", ["hm ... maybe later.", "Stop"]),
        ("Call `run. Now` twice. Then rest.", ["Call `run. Now` twice.", "Then rest."]),
        ("Visit towns, e.g. Oslo. Stay long.", ["Visit towns, e.g. Oslo.", "Stay long."]),
        ("Build 10.2.7 works. 12 tests pass.", ["Build 10.2.7 works.", "12 tests pass."]),
        ("open ended", ["open ended"]),
        ("\t\n ", []),
        ("Ärger. Öl.", ["Ärger.", "Öl."]),
    ],
)
def test_sentences(text, want):
    assert prose.sentences(text) == want


def test_sentences_of_a_long_text_take_linear_time():
    assert len(prose.sentences("One two. Three four! " * 40_000)) == 80_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_and_tokens(spark):
    assert one(spark, X.terms(F.lit("The foo_bar-baz/x.py, v1.2.3 ... Été"))) == ["the", "foo_bar-baz/x.py", "foo", "bar", "baz", "py", "v1.2.3", "v1", "été"]
    assert one(spark, X.terms(F.lit(""))) == []
    for t in ("", "a", "abcdefgh, éééé! x_y", "internationalisation"):
        assert one(spark, X.token_count(F.lit(t))) == prose.estimate_tokens(t)


def test_dice_and_ngrams(spark):
    d = lambda a, b: one(spark, X.dice(X.trigrams(F.lit(a)), X.trigrams(F.lit(b))))
    assert d("", "") == 1.0 and d("abc", "") == 0.0 and d("ab", "ab") == 1.0 and d("abcd", "ABC D") == 2 * 1 / 5
    assert one(spark, X.query_ngrams(F.lit("An old (stone) mill"))) == ["an", "old", "stone", "mill", "an old", "old stone", "stone mill", "an old stone", "old stone mill", "an old stone mill"]


def test_entities(spark):
    text = "The Corin Lighthouse shone on 1998-11-02. Édith Marchand owed $35 after 12 ms in lib/core.py on Mar 9, 2017. We did. EU `Hidden Name` Open\n```\nInside Block 2001-01-01\n```\nAfter `open span Lost"
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    got = {(r["kind"], r["value"]) for r in X.entities(rows, "id", "text").collect()}
    assert {("proper", "corin lighthouse"), ("date", "1998-11-02"), ("date", "mar 9, 2017"), ("proper", "marchand"), ("number", "$35"), ("number", "12 ms"), ("path", "lib/core.py")} <= got
    assert not {v for _, v in got} & {"we", "eu", "hidden name", "inside block", "2001-01-01", "lost", "after lost"}


@pytest.mark.parametrize("text", ["plain", "a `b c` d `e", "x\n```py\nin `it\n```\nout `y`", "~~~\nopen to the end", "  ```\nq\n  ```\n`z`", "``\n`a\nb`"])
def test_code_is_left_out_as_in_markdown(spark, text):
    words = lambda t: [x for line in t.split("\n") if (x := line.replace("`", " ").split())]
    assert words(one(spark, X.without_code(F.lit(text)))) == words(markdown.strip_code(text))


def test_blocks_and_paths():
    text = "# A\n\npara one\npara two\n\n### C\n- x\n- y\n\n```\n# not\n\n| a | b |\n|---|---|\n```\nSub\n---\n> quote\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n\n***\n~~~\nopen"
    got = [(b.kind, b.heading_path) for b in markdown.blocks(text)]
    assert got == [("heading", "A"), ("paragraph", "A"), ("heading", "A › C"), ("list", "A › C"), ("code", "A › C"), ("heading", "A › Sub"), ("quote", "A › Sub"), ("table", "A › Sub"), ("paragraph", "A › Sub"), ("rule", "A › Sub"), ("code", "A › Sub")]


def test_front_matter_links_tags_dates():
    note = "---\ntitle: \"T\"\ntags: [a, b]\naliases:\n  - x y\n---\nbody [[N#H|al]] ![[E]] [t](u.md#h) [w](http://a.b/c.md) `[[no]]` #tag C# (#two)\n# Head #three"
    assert markdown.front_matter(note) == {"title": ["T"], "tags": ["a", "b"], "aliases": ["x y"]}
    found = markdown.links(note)
    assert [(x["target"], x["heading"], x["alias"], x["embed"]) for x in found] == [("N", "H", "al", False), ("E", "", "", True), ("u.md", "h", "t", False)]
    assert markdown.tags(note) == ["tag", "two"]


@pytest.mark.parametrize(
    "name,want",
    [("d/2023-11-09 Standup.md", "2023-11-09"), ("20231109.md", "2023-11-09"), ("2023_11_09x.markdown", "2023-11-09"), ("25-12-2022.md", "2022-12-25"), ("12-25-2022 eve", "2022-12-25"), ("04-05-2022", "2022-05-04"), ("v2.md", None), ("1850-01-01.md", None), ("2023-02-30.md", None), ("notes", None), ("x\\2021-01-02 Monday.md", "2021-01-02")],
)
def test_daily_dates(spark, name, want):
    assert one(spark, X.daily_date(F.lit(name))) == want


def test_clips_slugs_and_numbers(spark):
    for most in range(12):
        text = "aé世🙂b"
        want = text.encode()[:most].decode("utf-8", "ignore")
        assert one(spark, X.clip_bytes(F.lit(text), most)) == want
    assert one(spark, X.clip_chars(F.lit("abcé"), 3)) == "abc\n\n[… truncated]" and one(spark, X.clip_chars(F.lit("abc"), 3)) == "abc" == one(spark, X.clip_chars(F.lit("abc"), 0))
    assert one(spark, X.slug(F.lit(" My Skill: 2é! "))) == "my-skill-2"
    assert [one(spark, X.short_number(F.lit(n))) for n in (0, 999, 1000, 1249, 9949, 9999, 10_499, 10_500)] == ["0", "999", "1.0k", "1.2k", "9.9k", "10.0k", "10k", "11k"]
    assert one(spark, X.ordered_distinct(F.array(*map(F.lit, (" b", "a", "", "b ", "a"))))) == ["b", "a"]
    head = "---\nname: x\n  max : 5\nbad line\nname: y: z\n---\n\nbody\n---\nmore"
    assert one(spark, X.flat_field(F.lit(head), "name")) == "y: z" and one(spark, X.flat_field(F.lit(head), "max")) == "5" and one(spark, X.flat_field(F.lit(head), "bad line")) is None
    assert one(spark, X.flat_body(F.lit(head))) == "body\n---\nmore" and one(spark, X.flat_body(F.lit("---\nopen: x"))) == "---\nopen: x" and one(spark, X.flat_body(F.lit("---\n---\nb"))) == "b"


def test_embedders_and_counters_can_be_exchanged(spark):
    class Letters:
        name, dims = "letters", 3

        def __call__(self, texts):
            return [[float(t.count(c)) for c in "abc"] for t in texts]

        def query(self, text):
            return self([text])[0]

    from marlstone.operators import ingest

    rows = spark.createDataFrame([(1, "aab"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["embedding"] for r in ingest.text_vectors(rows, embedder=Letters()).collect()} == {1: [2.0, 1.0, 0.0], 2: [0.0, 0.0, 0.0]}
    assert embedding.resolve([("m", lambda: 1 / 0), ("l", Letters)])[1] == "" and embedding.resolve([("m", lambda: 1 / 0)]) == (None, "m: division by zero") and embedding.resolve([])[0] is None
    plain, asked = embedding.HashEmbedder(), embedding.HashEmbedder(prefix="query: ")
    assert plain.query("x y") == plain(["x y"])[0] != asked.query("x y") and asked(["x y"]) == plain(["x y"])
    text = "# T\n\n" + " ".join(f"Cats {w} purr softly." for w in "abcdefgh") + " " + " ".join(f"Rockets {w} burn fuel." for w in "abcdefgh")
    cats = lambda texts: [[1.0, 0.0] if "Cats" in t else [0.0, 1.0] for t in texts]
    assert [c.text.count("Rockets") for c in ingest.chunker("semantic", lambda t: 100 * len(t.split()) // 2, cats)(text)][0] == 0
    assert len(ingest.chunker("headings", lambda t: 10 * len(t))(text)) > len(ingest.chunker("headings")(text))
    with pytest.raises(ValueError):
        ingest.chunker("other")


def test_chunks_keep_everything():
    rng = random.Random(1)
    para = lambda n: " ".join(f"Sentence {i} says {rng.random()}." for i in range(n))
    text = f"# A\n\n{para(3)}\n\n{para(90)}\n\n```\n{'code ' * 600}\n```\n\n## Empty\n\n## B\n\ntiny"
    for cut in (chunking.by_headings, chunking.by_communities):
        chunks = cut(markdown.blocks(text))
        assert all(c.tokens <= chunking.MOST or c.text.startswith("```") for c in chunks)
        assert "Empty" not in {c.heading_path for c in chunks} and sum("code code" in c.text for c in chunks) == 1
        joined = " ".join(c.text for c in chunks)
        assert all(f"Sentence {i} says" in joined for i in range(90))
    assert chunking.embedded_text("A › B", "", "r " * 200, "body").count("r") <= chunking.REASONING + 4


@pytest.mark.parametrize("k,size", [(3, 6), (4, 5), (5, 8)])
def test_leiden_finds_planted_groups(k, size):
    n = k * size
    edges = {(a, b): 1.0 for a, b in combinations(range(n), 2) if a // size == b // size}
    edges |= {(i * size, (i + 1) * size): 0.05 for i in range(k - 1)}
    part = community.leiden(n, edges, seed=4)
    agree = np.mean([(part[a] == part[b]) == (a // size == b // size) for a, b in combinations(range(n), 2)])
    assert agree >= 0.95 and part == community.leiden(n, edges, seed=4)
    assert community.quality(edges, part) >= community.quality(edges, list(range(n)))
    assert community.leiden(0, {}) == [] and community.leiden(1, {}) == [0]


def test_web():
    long_text = "This is a sentence that is long enough to be prose, as it has more than eighty bytes in it."
    page = f"""<html><head><title>t</title><script id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": {"x": [long_text], "query": long_text + "!"}}})}</script>
    <script type="application/ld+json">{{"name": "n", "description": "A description of more than thirty bytes."}}</script>
    <script>window.__INITIAL_STATE__ = {{"a": "{long_text}?"}}; $('#t').DataTable({{ajax: '/api/rows'}}); DataTable('#t', {{ "url": 1, ajax: "/api/rows" }})</script></head>
    <body><nav>menu</nav><article><h1>Title</h1><p>Para <b>bold</b> &amp; <a href="/x">link</a></p><div class="ad-box">buy</div><table id="t"><thead><tr><th>a</th></tr></thead><tbody></tbody></table></article></body></html>"""
    assert "menu" in web.visible_text(page) and "pageProps" not in web.visible_text(page) and "&" in web.visible_text(page)
    art = web.article(page)
    assert art.startswith("# Title") and "**bold** & [link](/x)" in art and "buy" not in art and "menu" not in art
    assert web.state_text(page) == f"{long_text}\n\nA description of more than thirty bytes.\n\n{long_text}?"
    assert web.data_table(page, "http://h/p") == {"selector": "#t", "url": "http://h/api/rows"} and not web.table_is_filled(page, "#t")
    assert web.table_header(page, "#t") == ["a"] and web.table_header(page, "#none") == [] and web.table_header("<table id=t><thead><tr><th> </th><th>x<b>y</b></th></tr></thead><tbody><tr><th>no</th></tr></tbody></table>", "t") == ["xy"]
    asked = []
    reply = lambda text: lambda url: asked.append(url) or text
    assert web.fetched_table(page, "http://h/p", reply('{"data": [{"p": 1, "q": 2}, {"q": 4, "p": 3}]}')) == "| a |  |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |" and asked == ["http://h/api/rows"]
    bare = page.replace("<th>a</th>", "")
    assert web.fetched_table(bare, "http://h/p", reply('{"aaData": [{"p": 1}]}')) == "| p |\n| --- |\n| 1 |"
    assert [web.fetched_table(page, "http://h/p", reply(x)) for x in (None, "", "oops", "[]", "3", '{"data": 1}')] == [""] * 6
    assert web.fetched_table(page.replace("<tbody>", "<tbody><tr><td>1</td></tr>"), "http://h/p", reply('{"data": [[1]]}')) == "" and web.fetched_table("", "", reply("[[1]]")) == ""
    assert web.table_rows('{"data": [{"a": "<b>1</b>", "b": null}, ["x|y"]]}') == [["1", ""], ["x|y"]]
    assert web.table_markdown([["a", "b"], ["x|y"]]) == "| a | b |\n| --- | --- |\n| x\\|y |  |"
    assert [s for v in web.scripts("<p>no</p>").values() for s in v] == [] and web.article("") == ""
    assert web.links_by_class('<a class="r" href="u">T</a><td class="s">S</td>', "r", "s") == [{"title": "T", "url": "u", "snippet": "S"}]


def test_embedding_is_a_unit_vector():
    v = np.array(embedding.embed("Some words here"))
    assert abs(np.linalg.norm(v) - 1) < 1e-5 and embedding.embed("")[0] == 1.0 and embedding.feature_hash("") == 14695981039346656037
    near, far = (v @ np.array(embedding.embed(t)) for t in ("some WORDS  here", "entirely different"))
    assert near > 0.999 > far
