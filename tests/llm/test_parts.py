"""Hashing, lookups and caches that the operators share."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marlstone.llm import bytehash, packing, subword, worker
from marlstone.llm.bytehash import U64


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_index_finds_its_keys_only(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(U64))
    index = bytehash.Index(keys)
    assert np.array_equal(index.find(keys), np.arange(len(keys)))
    assert (index.find(keys + U64(1 << 63)) == -1).all()


def test_names_of_substrings():
    data = np.frombuffer(b"abcXabcxABC", np.uint8)
    p, low = bytehash.Prefix(data, 1), bytehash.Prefix(data, 1, lower=True)
    at = np.array([0, 4, 8])
    assert len(set(p.of(at, at + 3).tolist())) == 2 and len(set(low.of(at, at + 3).tolist())) == 1
    assert p.of(np.array([0]), np.array([0])) == p.of(np.array([5]), np.array([5]))
    assert len(p.every(3)) == 9 and p.every(3)[0] == p.every(3)[4] and len(p.every(12)) == 0


def test_slices_cover_all_rows():
    texts = pa.array(["", None, "é" * 30, "x", "y" * 500, None, ""])
    rows = []
    for lo, hi, data, off in bytehash.slices(texts.slice(1), 64):
        assert len(off) == hi - lo + 1 and off[-1] == len(data)
        rows += [data[a:b].tobytes().decode() for a, b in zip(off, off[1:], strict=False)]
    assert rows == ["", "é" * 30, "x", "y" * 500, "", ""] and list(bytehash.slices(texts.slice(0, 0))) == []


def test_words_end_with_their_row():
    texts = [" a bc", "d\te\x0b", "", "f"]
    for _, _, data, off in bytehash.slices(pa.array(texts)):
        start, end = bytehash.word_bounds(data, off)
        assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [b"a", b"bc", b"d", b"e", b"f"]


def test_memo_gives_equal_pieces_when_it_overflows(monkeypatch):
    rule = subword.merges(public_tokenizers.path("piece_bpe_32k.model"))
    texts = pa.array([f"alpha beta{i % 7} gamma{i}" for i in range(60)])

    def run():
        out = []
        for lo, hi, data, off in bytehash.slices(texts, 256):
            out += subword.encode_slice(rule, data, off, np.arange(lo, hi).astype(U64), 0.3, 9)[0].tolist()
        return out

    subword._MEMOS.clear()
    want = run()
    assert run() == want
    monkeypatch.setattr(subword.Memo, "MOST", 10)
    subword._MEMOS.clear()
    assert run() == want


def test_word_encoder_forgets_and_agrees(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "_MOST_WORDS", 3)
    encode = packing.WordEncoder(path)
    text = "One two's THREE 4 five six é <|endoftext|>x \x1c seven"
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text.encode()), "<u4").tolist() == want == np.frombuffer(encode(text.encode()), "<u4").tolist()


def test_a_worker_keeps_the_caches_of_one_operator():
    packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    worker.claim("a")
    packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    worker.claim("a")
    assert packing._ENCODERS
    worker.claim("b")
    assert not packing._ENCODERS


def plain_agenda(rule, model, text, doc_key, dropout, seed):
    """The definition, one part and one merge at a time, with whole numbers only."""
    full = (1 << 64) - 1

    def scramble(x):
        x &= full
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    number = {t: i for t, i in ((model.id_to_piece(i), i) for i in range(model.get_piece_size())) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    order = {i: r for r, i in enumerate(sorted(number.values(), key=lambda i: (-model.get_score(i), i)))}
    out, parts = [], re.findall(r" +[^ ]*", f" {text}") if text else []
    for place, part in enumerate(parts):
        key = scramble(doc_key + place * 0xBF58476D1CE4E5B9 + seed * 0xBF58476D1CE4E5B9)
        have = [(i, "\ufffe" if ch == "▁" else ch.replace(" ", "▁")) for i, ch in enumerate(part)]
        while True:
            best = None
            for k in range(len(have) - 1):
                piece = number.get(have[k][1] + have[k + 1][1])
                if piece is not None and scramble(key + have[k][0] * 0xBF58476D1CE4E5B9 + piece * 0x94D049BB133111EB) >= int(dropout * 2.0**64):
                    best = min(best or (order[piece], k), (order[piece], k))
            if best is None:
                break
            k = best[1]
            have[k : k + 2] = [(have[k][0], have[k][1] + have[k + 1][1])]
        for i, s in have:
            s = "▁" if s == "\ufffe" else s
            if s in number and not (s == "▁" and part[i] == "▁"):
                out.append(number[s])
            else:
                out += [model.piece_to_id(f"<0x{b:02X}>") for b in s.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.6])
def test_dropout_is_that_of_a_plain_agenda(dropout, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rule, model = subword.merges(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["internationalization of the  thinking\nsentence ", "", "naïve ▁ mark 世界 " + "x" * 30, "  aaaa" + "banana" * 12, None]
    keys = [7, 99, 3, (1 << 64) - 5, 1]
    want = [plain_agenda(rule, model, t, k, dropout, 20) for t, k in zip(texts, keys, strict=True)]
    for wide in (512, 8, 0):
        monkeypatch.setattr(subword, "WIDE", wide)
        got = []
        for lo, hi, data, off in bytehash.slices(pa.array(texts)):
            ids, n = subword.encode_slice(rule, data, off, np.array(keys[lo:hi], U64), dropout, 20)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_long_parts_cost_in_proportion():
    import time

    rule, took = subword.merges(public_tokenizers.path("piece_bpe_32k.model")), []
    for n in (20_000, 80_000):
        text, began = "banana" * (n // 6), time.thread_time()
        subword.encode_slice(rule, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), np.array([1], U64), 0.1, 20)
        took.append(time.thread_time() - began)
    assert took[1] < 9 * took[0] + 0.5


def test_tokenizers_that_look_across_words_are_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
