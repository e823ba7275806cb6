"""Operators on documents against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from marlstone.llm import langid, lattice, minhash, packing, repeats, sharding, subword

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, hash long, shard int, word string, component long, score double"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside; rows are (doc_id, text[, lang])."""
    full = [(i, t, *(rest or ("en",)), "s", len(t or ""), "x", 7, 3, "w", 9, 0.5) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, repeated rows, copies, near-copies, one long text, ties."""
    rng = random.Random(5)
    base, shared = prose(rng, 300), prose(rng, 120)
    words = base.split()
    near = [" ".join(w if rng.random() > p else "zz" for w in words) for p in (0.01, 0.02, 0.03, 0.05, 0.08)]
    texts = [None, "", "  \n\t ", "123 %%% 456", "a", "One two three", "one TWO three", base, base, *near, f"start {shared} end of one", f"{prose(rng, 80)} {shared}", "x" * 1500, "ab" * 700, prose(rng, 9000), "🙂 naïve\x00text <|endoftext|> ▁ mark", "one two three four five", "one two three four five"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "without an id " * 5), (None, None)]


def test_shards_are_exact_and_gapless(spark, odd):
    out = sharding.hypergeometric_shuffle(frame(spark, odd), 16, rows_per_block=5).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == len(odd) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert Counter(r["text"] for r in out) == Counter(t for _, t in odd)
    assert sharding.hypergeometric_shuffle(frame(spark, odd).limit(0), 16).count() == 0


def test_communication_matrix_has_its_sums_and_law():
    m = sharding.communication_matrix([5, 0, 9, 2], [4, 4, 4, 4], 3)
    assert [sum(r) for r in m] == [5, 0, 9, 2] and [sum(c) for c in zip(*m, strict=True)] == [4, 4, 4, 4]
    rng, n = random.Random(1), 4000
    seen = Counter(sharding.hypergeometric(rng, 6, 10, 5) for _ in range(n))
    for k in range(6):
        p = math.comb(6, k) * math.comb(10, 5 - k) / math.comb(16, 5)
        assert abs(seen[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lattice._LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, odd):
    sets = {}
    for i, t in odd:
        if i is not None:
            sets.setdefault(i, shingles(t))
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    out = minhash.near_duplicates(frame(spark, odd)).collect()
    assert len(out) == len(odd) and len(links) > 8
    for r in out:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])
        else:
            assert not r["kept"]
    assert minhash.near_duplicates(frame(spark, odd).limit(0)).count() == 0


def test_large_group_of_near_copies_is_joined_without_its_hub(spark):
    """A chain of texts, each near to the next only, and strays near to none."""
    rng = random.Random(3)
    words = prose(rng, 240).split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
    rows += [(1000 + i, " ".join(w if rng.random() > 0.2 else f"s{rng.random()}" for w in words)) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[250:1250]
    same = np.mean([x == y for s in range(6) for x, y in zip(minhash.sketch(a ^ np.uint64(s * 977)), minhash.sketch(b ^ np.uint64(s * 977)), strict=True)])
    assert abs(same - 750 / 1250) < 0.08
    for n in (1, 2, 7, 5000):
        assert minhash.sketch(rng.integers(0, 1 << 63, n).astype(np.uint64)).max() < np.iinfo(np.int64).max


def removed(texts, length):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in blobs for p in range(len(b) - length + 1))
    for b in blobs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        yield len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,gram", [(400, 160), (60, 20)])
def test_repeats_match_brute_force(spark, odd, length, gram):
    out = repeats.remove_repeats(frame(spark, odd), length=length, gram=gram).collect()
    want = Counter(zip([i for i, _ in odd], removed([t for _, t in odd], length), strict=True))
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in out) == want
    assert repeats.remove_repeats(frame(spark, odd).limit(0)).count() == 0


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    shared = prose(rng, 200)
    text = f"{prose(rng, 300)} {shared} {prose(rng, 300)} {shared}"
    whole = [x for lo, base, data, off in repeats._segments(pa.array([text]), 400) for x in zip(*repeats.anchors(data, off, 400, 160)[1:4], strict=True)]
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    parts = [(f + base, e + base, a + base) for lo, base, data, off in repeats._segments(pa.array([text]), 400) for f, e, a in zip(*repeats.anchors(data, off, 400, 160)[1:4], strict=True)]
    each = lambda runs: {p: a for f, e, a in runs for p in range(f, e + 1)}
    assert each(whole) == each(parts) and len(each(whole)) == len(text.encode()) - 399


def test_packing_is_whole_gapless_and_tight(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in odd:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    out = packing.pack_documents(frame(spark, odd), WORDS, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(frame(spark, odd).limit(0), WORDS).count() == 0


def test_packing_is_near_the_least_number_of_sequences():
    rng = np.random.default_rng(4)
    lengths = np.minimum(2047, rng.lognormal(6.5, 0.9, 20_000).astype(int) + 1)
    bins, offset = packing.pack(lengths)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048 and len(fill) <= 1.005 * lengths.sum() / 2048 + 2
    assert packing.pack(np.array([], np.int64))[0].size == 0


@pytest.mark.parametrize("dropout", [0.0, 0.1, 1.0])
def test_encoding_is_lossless_and_seeded(spark, odd, dropout):
    import sentencepiece

    rule = subword.merges(PIECES)
    run = lambda seed: subword.encode_documents(frame(spark, odd), PIECES, dropout=dropout, seed=seed).collect()
    out = run(1)
    assert len(out) == len(odd)
    for r in out:
        assert subword.decode(rule, np.array(r["ids"], np.int64)).decode() == (r["text"] or "")
    key = lambda rows: Counter((r["doc_id"], tuple(r["ids"])) for r in rows)
    assert key(run(1)) == key(out)
    if dropout == 0.1:
        assert key(run(2)) != key(out)
    if dropout == 0.0:
        model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        assert all(r["ids"] == model.encode(r["text"]) for r in out if r["text"] and "▁" not in r["text"])
    if dropout == 1.0:
        assert all(len(r["ids"]) >= len(r["text"] or "") for r in out)


def test_dropout_varies_every_occurrence(spark):
    word, rows = "internationalization", [(i, "internationalization " * 40) for i in range(30)]
    out = subword.encode_documents(frame(spark, rows), PIECES, dropout=0.3, seed=1).collect()
    rule, seen, texts = subword.merges(PIECES), set(), set()
    for r in out:
        texts.add(tuple(r["ids"]))
        parts, last = [], b""
        for i in r["ids"]:
            if rule.strings[i].startswith(b" "):
                parts.append([])
            parts[-1].append(i)
            last += rule.strings[i]
        assert last.decode() == " " + r["text"]
        seen.update(tuple(p) for p in parts if b"".join(rule.strings[i] for i in p).decode().strip() == word)
    # Remainders modulo four gave at most four segmentations in all.
    assert len(seen) > 40 and len(texts) == len(rows)


def test_lattice_sums_over_all_segmentations():
    begin, inner, lb, li = lattice.vocabulary(PIECES)
    first, rest = dict(zip(begin, lb, strict=True)), dict(zip(inner, li, strict=True))

    def tail(word):
        return 1.0 if not word else sum(math.exp(rest[word[:k]]) * tail(word[k:]) for k in range(1, len(word) + 1) if word[:k] in rest)

    words = [b"", b"a", b"the", b"lation", "été".encode(), b"\xff\x00z"]
    want = [sum(math.exp(first[w[:k]]) * tail(w[k:]) for k in range(len(w) + 1) if w[:k] in first) for w in words]
    assert np.allclose(np.exp(lattice.log_marginals(words, PIECES, lb, li)), want)
    used = lattice.expected_counts(words, np.ones(len(words)), PIECES, lb, li)
    assert math.isclose(used[0].sum(), len(words))  # each word begins once
    # A first piece and any number of others: all words together have probability 1.
    assert math.isclose(np.exp(lb).sum() + np.exp(li).sum(), 1.0)


def test_long_words_are_worked_on_in_windows(monkeypatch):
    _, _, begin, inner = lattice.vocabulary(PIECES)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdetion \xc3\xa9") for _ in range(n)) for n in (1, 22, 23, 24, 63, 64, 65, 128, 300)]
    want, used = lattice.log_marginals(words, PIECES, begin, inner), lattice.expected_counts(words, np.ones(len(words)), PIECES, begin, inner)
    for most in (64, 1, 30):
        monkeypatch.setattr(lattice, "LONG", most)
        assert np.allclose(lattice.log_marginals(words, PIECES, begin, inner), want)
        got = lattice.expected_counts(words, np.ones(len(words)), PIECES, begin, inner)
        assert np.allclose(got[0], used[0]) and np.allclose(got[1], used[1])


def plain_lattice_model(texts, training):
    """Every segmentation of every word spelled out; the whole model over again in plain Python."""
    begin, inner, lb, li = lattice.vocabulary(PIECES)
    weight = ({p: math.exp(x) for p, x in zip(begin, lb, strict=True)}, {p: math.exp(x) for p, x in zip(inner, li, strict=True)})
    prior = [{p: lattice.PRIOR * x for p, x in w.items()} for w in weight]

    def ways(word, first=True):
        table = weight[0] if first else weight[1]
        if not first and not word:
            yield (), 1.0
            return
        for k in range(0 if first else 1, len(word) + 1):
            if word[:k] in table:
                for rest, x in ways(word[k:], False):
                    yield (word[:k], *rest), x * table[word[:k]]

    words = [t.encode().translate(lattice._LOWER).split() for t in texts]
    seen = Counter(w for ws, t in zip(words, training, strict=True) if t for w in ws)
    for _ in range(lattice.ROUNDS):
        uses = [Counter(p) for p in prior]
        for w in seen:
            every = list(ways(w))
            total = sum(x for _, x in every)
            for pieces, x in every:
                uses[0][pieces[0]] += x / total
                for p in pieces[1:]:
                    uses[1][p] += x / total
        total = sum(sum(u.values()) for u in uses)
        weight = tuple({p: x / total for p, x in u.items()} for u in uses)
    n, texts_n = sum(seen.values()), sum(training)
    times = Counter(seen.values())
    d = times[1] / (times[1] + 2 * times[2])
    end = (texts_n + 0.5) / (n + texts_n + 1)
    for ws in words:
        both = [math.log10(end)] * 2
        for w in ws:
            marginal = sum(x for _, x in ways(w))
            both[0] += math.log10(1 - end) + math.log10(max(0, seen[w] - d) / n + d * len(seen) / n * marginal)
            both[1] += math.log10(1 - end) + math.log10(marginal)
        yield both


@pytest.mark.parametrize("head", [0, 3, 500_000])
def test_lattice_scores_of_whole_texts_match_brute_force(spark, head):
    texts = ["the cat sat", "The dog sat sat", "", "a station", "unseen été cat", "the the cats\nThe", "dog"]
    training = [True, True, True, True, False, False, True]
    want = list(plain_lattice_model(texts, training))
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, training, strict=True))], "doc_id long, text string, training boolean")
    out = {r["doc_id"]: (r["score"], r["lattice_score"]) for r in lattice.lattice_scores(docs, PIECES, "training", head_words=head).collect()}
    assert np.allclose([out[i] for i in range(len(texts))], want, atol=1e-8)


def test_lattice_scores_stay_with_their_rows(spark, odd):
    docs = frame(spark, odd).filter("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("*", "true AS training")
    run = lambda df: {r["doc_id"]: (r["n_tokens"], round(r["score"], 6)) for r in lattice.lattice_scores(df, PIECES, "training").collect()}
    assert run(docs.repartition(7)) == run(docs)


@pytest.mark.parametrize("head", [0, 20, 500_000])
def test_lattice_base_scores_match_brute_force(spark, odd, head):
    rows = [(i, t, "en" if k % 4 else "held") for k, (i, t) in enumerate(odd)]
    words = [[*(t or "").encode().translate(lattice._LOWER).split(), "end"] for _, t, _ in rows]
    c = Counter(w for ws, r in zip(words, rows, strict=True) if r[2] == "en" for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for (i, _, _), ws in zip(rows, words, strict=True))
    docs = frame(spark, rows).selectExpr("*", "lang = 'en' AS training")
    out = lattice.lattice_scores(docs, PIECES, "training", head_words=head).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_lattice_without_training_or_rows(spark, odd):
    docs = frame(spark, odd).selectExpr("*", "false AS training")
    out = lattice.lattice_scores(docs, PIECES, "training").collect()
    assert len(out) == len(odd) and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in out)
    assert lattice.lattice_scores(docs.limit(0), PIECES, "training").count() == 0


def test_language_profiles(spark, odd):
    names, prototypes = langid.fit(frame(spark, [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "xx"), (4, "nothing", None), (5, "1 2", "zz")]))
    assert names == ["de", "en"]
    out = {r["doc_id"]: r for r in langid.identify(frame(spark, [(1, "and the cat"), (2, "die KATZE und"), (3, None), (4, " 12 %"), (5, "é")]), names, prototypes).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and out[5]["lang_pred"] in names
    assert all(0 <= r["score"] <= 1 for r in out.values()) and "n_chars" in out[1].asDict()
    empty = langid.fit(frame(spark, odd).limit(0))
    assert {r["lang_pred"] for r in langid.identify(frame(spark, odd), *empty).collect()} == {"und"}
    assert langid.identify(frame(spark, odd).limit(0), names, prototypes).count() == 0


def test_letters_of_every_plane_count():
    data = "\U00030000\U0003134a \U00031350".encode()
    rows, _, counts = langid.trigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(rows) and counts.sum() > 0


def test_profiles_are_bound_and_bundled():
    text = "Ab, ab c".encode()
    row, code, count = langid.trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    a, b, c = (1 + ord(x) for x in "abc")
    pack = lambda x, y, z: x << 24 | y << 12 | z
    assert dict(zip(code.tolist(), count.tolist(), strict=True)) == {pack(0, a, b): 2, pack(a, b, 0): 2, pack(b, 0, a): 1, pack(b, 0, c): 1, pack(0, c, 0): 1}
    vector = langid.profiles(row, code, count, 1)[0]
    assert np.array_equal(vector, sum(n * langid.trigram_vectors(np.array([k]))[0] for k, n in zip(code, count, strict=True)))


def test_blocks_of_a_group_meet_in_every_pair(spark, monkeypatch):
    """With tiny blocks a group has many of them, and of one size several."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    test_large_group_of_near_copies_is_joined_without_its_hub(spark)


def plain_profile(text):
    """Bundle of a text's bound trigrams, one at a time."""
    import unicodedata

    letters = np.random.default_rng(1988).choice(np.array([-1, 1], np.int8), (4096, 512)).astype(int)
    word = lambda chars: [0, *chars, 0]
    words, now = [], []
    for ch in text:
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            now.append(1 + ord(low if len(low) == 1 else ch) % 4095)
        elif now:
            words.append(word(now))
            now = []
    words += [word(now)] if now else []
    # Neighbouring words share the boundary between them.
    line = [0] if words else []
    for w in words:
        line += w[1:]
    grams = Counter(g for g in zip(line, line[1:], line[2:], strict=False) if (g[0] or g[1]) and (g[1] or g[2]))
    out = np.zeros(512, int)
    for (a, b, c), n in grams.items():
        out += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out, bool(grams)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_language_query_is_that_of_plain_profiles(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    made = {r["doc_id"]: plain_profile(r["text"] or "") for r in rows}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    sums = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + made[r["doc_id"]][0]
    names = sorted(k for k, v in sums.items() if v.any())
    out = {r["doc_id"]: r for r in langid.op5_language(spark, d).collect()}
    assert len(out) == len(rows) and any(held.values())
    for i, (profile, lettered) in made.items():
        assert out[i]["held_out"] == held[i]
        if not lettered:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
            continue
        cosine = [profile @ sums[k] / (np.linalg.norm(profile) * np.linalg.norm(sums[k])) for k in names]
        assert abs(out[i]["score"] - max(0.0, max(cosine))) < 1e-4
        assert cosine[names.index(out[i]["lang_pred"])] > max(cosine) - 1e-5
    right = [out[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if held[r["doc_id"]] and r["lang"] and r["text"]]
    assert sum(right) >= 0.95 * len(right) and len(right) > 10
