"""Language-model scores from a subword lattice.

Every segmentation of a word into pieces of an existing vocabulary counts: a
forward recursion in log space sums over all of them.  The first piece of a word
comes from the pieces that begin one, the rest from the others, single bytes
included, so each word has a probability and those of all words add up to 1.

The vocabulary's own scores, which rank its pieces, give the first weights (in
proportion to 1 / rank).  Rounds of expectation-maximisation over the distinct
words of the training texts re-estimate them; words count once, as what they
back off for are words not seen.  A whole word that was seen is
one more arc of its lattice: it gets its discounted relative frequency, and the
discounted mass weights the marginal over segmentations.  The vocabulary's scores
stay in the weights as a prior of ``PRIOR`` uses.  What the segmentations alone
give a text is returned as well.

A word of more than ``LONG`` bytes is worked on in windows of that size: its
forward recursion holds the last few ends only, expectations one number a byte.

Word counts are summed where they arise and kept as a table; texts are scored
against the most frequent words at hand (``HEAD`` of them, a fixed bound) and
join the table for all others.
"""

from __future__ import annotations

import functools
import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut, release
from .bytehash import U64, Index, Prefix, slices, word_bounds
from .langid import is_held_out
from .worker import claim

HEAD, ROUNDS, PRIOR = 500_000, 2, 100.0
LONG = 4096
_CELLS = 1 << 21  # lattice cells worked on at once


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Pieces that begin a word (without the mark), all other pieces and bytes, and first log weights of both."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    begin: dict[bytes, float] = {b"": 1.0}
    inner: dict[bytes, float] = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece, weight = model.id_to_piece(i), 1.0 / (1.0 - min(0.0, max(-1e6, model.get_score(i))))
        if mark not in piece:
            inner[piece.encode()] = weight
        elif piece.rfind(mark) == 0:
            begin[piece[1:].encode()] = weight
    total = sum(begin.values()) + sum(inner.values())
    return list(begin), list(inner), np.log(np.array([*begin.values()]) / total), np.log(np.array([*inner.values()]) / total)


class Pieces:
    """Lookup of byte strings by their names, to their numbers; -1 for none."""

    def __init__(self, strings: list[bytes]):
        ends = np.cumsum([len(s) for s in strings])
        prefix = Prefix(np.frombuffer(b"".join(strings), np.uint8), 23)
        self.index = Index(prefix.of(ends - [len(s) for s in strings], ends))
        self.longest = max(map(len, strings))

    def find(self, names: np.ndarray) -> np.ndarray:
        return self.index.find(names)


@functools.cache
def _lookups(path: str) -> tuple[Pieces, Pieces]:
    begin, inner, _, _ = vocabulary(path)
    return Pieces(begin), Pieces(inner)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """Positions of words of one length, of those that aren't long."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths[lengths <= LONG]):
        at = np.flatnonzero(lengths == n)
        step = max(1, _CELLS // (int(n) + 1) // 16)
        for lo in range(0, len(at), step):
            yield at[lo : lo + step], int(n)


def _arcs(words: list[bytes], at: np.ndarray, n: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers for words of one length: begin[word, end] and inner[word, end, length]."""
    begin, inner = _lookups(path)
    prefix = Prefix(np.frombuffer(b"".join(words[i] for i in at), np.uint8), 23)
    base = np.arange(len(at))[:, None] * n
    first = np.full((len(at), n + 1), -1)
    first[:, 0] = begin.find(prefix.of(base[:, 0], base[:, 0]))
    for e in range(1, min(n, begin.longest) + 1):
        first[:, e] = begin.find(prefix.of(base[:, 0], base[:, 0] + e))
    longest = min(n, inner.longest)
    rest = np.full((len(at), n + 1, longest + 1), -1)
    for k in range(1, longest + 1):
        starts = base + np.arange(n - k + 1)[None, :]
        rest[:, k:, k] = inner.find(prefix.of(starts.ravel(), starts.ravel() + k)).reshape(starts.shape)
    return first, rest


def _weights(numbers: np.ndarray, logs: np.ndarray) -> np.ndarray:
    return np.where(numbers >= 0, logs[numbers], -np.inf)


def forward(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all segmentations up to each end."""
    alpha = first.copy()
    for e in range(1, first.shape[1]):
        k = min(e, rest.shape[2] - 1)
        paths = np.concatenate([alpha[:, e : e + 1], alpha[:, e - k : e][:, ::-1] + rest[:, e, 1 : k + 1]], axis=1)
        top = paths.max(axis=1)
        safe = np.where(top > -np.inf, top, 0)
        with np.errstate(divide="ignore"):
            alpha[:, e] = np.log(np.exp(paths - safe[:, None]).sum(axis=1)) + safe
    return alpha


def _window(word: bytes, lo: int, hi: int, path: str) -> np.ndarray:
    """Piece numbers inner[end - lo - 1, length] of the pieces that end behind ``lo``, up to ``hi``."""
    inner = _lookups(path)[1]
    back = min(lo, inner.longest)
    prefix = Prefix(np.frombuffer(word, np.uint8)[lo - back : hi], 23)
    ends = np.arange(back + 1, back + hi - lo + 1)
    out = np.full((hi - lo, inner.longest + 1), -1)
    for k in range(1, inner.longest + 1):
        fits = ends[ends >= k]
        out[ends >= k, k] = inner.find(prefix.of(fits - k, fits))
    return out


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return top + math.log(np.exp(x - top).sum()) if top > -np.inf else top


def _first_pieces(word: bytes, path: str) -> np.ndarray:
    """Numbers of the pieces that begin a word, by their end."""
    begin = _lookups(path)[0]
    e = np.arange(min(len(word), begin.longest) + 1)
    return begin.find(Prefix(np.frombuffer(word[: begin.longest], np.uint8), 23).of(np.zeros_like(e), e))


def long_forward(word: bytes, path: str, begin: np.ndarray, inner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Window by window, the first end and ``forward``'s weights of a single word."""
    first = _weights(_first_pieces(word, path), begin)
    past = first[:1]
    yield 0, past
    for lo in range(0, len(word), LONG):
        hi = min(lo + LONG, len(word))
        arcs = _weights(_window(word, lo, hi, path), inner)
        base = lo + 1 - len(past)
        alpha = np.concatenate([past, np.full(hi - lo, -np.inf)])
        for e in range(lo + 1, hi + 1):
            k, at = min(e, arcs.shape[1] - 1), e - base
            paths = alpha[at - k : at][::-1] + arcs[e - lo - 1, 1 : k + 1]
            alpha[at] = _log_sum(np.append(paths, first[e]) if e < len(first) else paths)
        yield lo + 1, alpha[len(past) :]
        past = alpha[-(arcs.shape[1] - 1) :]


def _long_counts(word: bytes, path: str, begin: np.ndarray, inner: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> None:
    """Add the expected uses of pieces in one long word."""
    n = len(word)
    alpha = np.concatenate([a for _, a in long_forward(word, path, begin, inner)])
    total, after = alpha[n], np.zeros(1)  # weights from each end to the word's end, of the ends that follow
    for lo in reversed(range(0, n, LONG)):
        hi = min(lo + LONG, n)
        most = _lookups(path)[1].longest
        top = min(n, hi + most)
        numbers = _window(word, lo, top, path)
        arcs = _weights(numbers, inner)
        beta = np.concatenate([np.full(hi - lo, -np.inf), after[: top - hi + 1]])  # of ends lo to top
        for s in range(hi - 1, lo - 1, -1):
            k = np.arange(1, min(n - s, most) + 1)
            beta[s - lo] = _log_sum(beta[s - lo + k] + arcs[s - lo + k - 1, k])
        for k in range(1, most + 1):
            ends = np.arange(max(lo + 1, k), hi + 1)
            at = numbers[ends - lo - 1, k]
            ok = at >= 0
            sums[1][:] += np.bincount(at[ok], np.exp(alpha[ends[ok] - k] + arcs[ends[ok] - lo - 1, k] + beta[ends[ok] - lo] - total), len(inner))
        after = beta
    first = _first_pieces(word, path)
    ok = np.flatnonzero(first >= 0)
    np.add.at(sums[0], first[ok], np.exp(begin[first[ok]] + after[ok] - total))


def log_marginals(words: list[bytes], path: str, begin: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all segmentations."""
    out = np.zeros(len(words))
    for i, w in enumerate(words):
        if len(w) > LONG:
            for _, alpha in long_forward(w, path, begin, inner):
                out[i] = alpha[-1]
    for at, n in _by_length(words):
        first, rest = _arcs(words, at, n, path)
        out[at] = forward(_weights(first, begin), _weights(rest, inner))[:, n]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, path: str, begin: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each piece is used, over all segmentations of all words."""
    sums = np.zeros(len(begin)), np.zeros(len(inner))
    for w, times in zip(words, counts.tolist(), strict=True):
        for _ in range(int(times) if len(w) > LONG else 0):
            _long_counts(w, path, begin, inner, sums)
    for at, n in _by_length(words):
        first, rest = _arcs(words, at, n, path)
        w_first, w_rest = _weights(first, begin), _weights(rest, inner)
        alpha = forward(w_first, w_rest)
        # Backward weights: from each end to the end of the word.
        beta = np.full(alpha.shape, -np.inf)
        beta[:, n] = 0
        for s in range(n - 1, -1, -1):
            ks = np.arange(1, min(n - s, rest.shape[2] - 1) + 1)
            paths = beta[:, s + ks] + w_rest[:, s + ks, ks]
            top = paths.max(axis=1)
            safe = np.where(top > -np.inf, top, 0)
            with np.errstate(divide="ignore"):
                beta[:, s] = np.log(np.exp(paths - safe[:, None]).sum(axis=1)) + safe
        total, times = alpha[:, n], counts[at]
        use = np.exp(w_first + beta - total[:, None]) * times[:, None]
        ok = first >= 0
        sums[0][:] += np.bincount(first[ok], use[ok], len(begin))
        for k in range(1, rest.shape[2]):
            use = np.exp(alpha[:, : n + 1 - k] + w_rest[:, k:, k] + beta[:, k:] - total[:, None]) * times[:, None]
            ok = rest[:, k:, k] >= 0
            sums[1][:] += np.bincount(rest[:, k:, k][ok], use[ok], len(inner))
    return sums


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(training, text) to (word, count in training texts, count in all), summed as far as memory allows."""
    claim("lattice")
    seen: list[Counter] = [Counter(), Counter()]

    def table() -> pa.RecordBatch:
        words = list(seen[0].keys() | seen[1].keys())
        learned = [seen[1][w] for w in words]
        every = [seen[0][w] + n for w, n in zip(words, learned, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(learned, pa.int64()), pa.array(every, pa.int64())], names=["word", "n", "n_all"])

    for batch in batches:
        training = batch.column(0).to_pylist()
        for i in range(batch.num_rows):
            text = batch.column(1)[i]
            if text.is_valid:
                seen[bool(training[i])].update(text.as_buffer().to_pybytes().translate(_LOWER).split())
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield table()
            seen = [Counter(), Counter()]
    if seen[0] or seen[1]:
        yield table()


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches joined into larger ones: words are worked on together by their length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _expected(path: str, begin: np.ndarray, inner: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lattice")
        sums = np.zeros(len(begin) + len(inner))
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            sums += np.concatenate(expected_counts(words, np.ones(len(words)), path, begin, inner))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["piece", "uses"])

    return run


def _marginal(path: str, begin: np.ndarray, inner: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            logs = log_marginals(batch.column(0).to_pylist(), path, begin, inner)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs)], names=[*batch.schema.names, "lattice"])

    return run


class Model:
    """Corpus figures and what a word's count and marginal make of them."""

    def __init__(self, n_words: int, n_texts: int, n_distinct: int, once: int, twice: int):
        self.words, self.texts, self.distinct = n_words, n_texts, n_distinct
        self.tokens = n_words + n_texts
        self.discount = once / (once + 2 * twice) if once else 0.5
        self.kinds = n_distinct + (n_texts > 0)
        total = self.tokens + 0.1 * (self.kinds + 1)
        self.base_log = lambda c: np.log10((c + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))
        self.base_end = math.log10((n_texts + 0.1) / total)
        end = (n_texts + 0.5) / (self.tokens + 1)
        self.end, self.on = math.log10(end), math.log10(1 - end)

    def word_log(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability of a word as the next token."""
        marginal = np.exp(lattice)
        if not self.words:
            return self.on + lattice / math.log(10)
        spare = self.discount * self.distinct / self.words
        with np.errstate(divide="ignore"):
            seen = np.log10(np.maximum(c - self.discount, 0) / self.words + spare * marginal)
        # Marginals too small for a double stay in logs.
        return self.on + np.where(np.isfinite(seen), seen, np.log10(spare) + lattice / math.log(10))


def _scored(model: Model, head, seed: int = 31):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, lattice = head.value
        index, columns = Index(names), (counts > 0, model.base_log(counts), model.word_log(counts, lattice), lattice / math.log(10))
        for batch in batches:
            uids = batch.column(0).to_numpy()
            n = batch.num_rows
            sums = np.zeros((5, n))
            rare: list[list] = [[], [], []]
            for lo, hi, data, off in slices(batch.column(2)):
                start, end = word_bounds(data, off)
                own = lo + np.searchsorted(off, start, "right") - 1
                mine = Prefix(data, seed, lower=True).of(start, end)
                at = index.find(mine)
                hit = at >= 0
                sums[0] += np.bincount(own, minlength=n)
                for k, column in enumerate(columns, 1):
                    sums[k] += np.bincount(own[hit], column[at[hit]], n)
                miss = np.flatnonzero(~hit)
                if len(miss):
                    key, first, times = np.unique(np.stack([own[miss].astype(U64), mine[miss]]), axis=1, return_index=True, return_counts=True)
                    lowered = data.tobytes().translate(_LOWER)
                    rare[0] += uids[key[0].astype(np.int64)].tolist()
                    rare[1] += [lowered[a:b] for a, b in zip(start[miss[first]].tolist(), end[miss[first]].tolist(), strict=True)]
                    rare[2] += times.tolist()
            k = len(rare[0])
            nothing = pa.nulls(k, pa.float64())
            whole = [pa.array(np.concatenate([uids, np.array(rare[0], np.int64)])), pa.concat_arrays([batch.column(1), pa.nulls(k, pa.int64())]), pa.array([None] * n + rare[1], pa.binary()), pa.array(np.concatenate([sums[0].astype(np.int64), np.array(rare[2], np.int64)]))]
            whole += [pa.concat_arrays([pa.array(sums[r]), nothing]) for r in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(whole, names=["uid", "doc_id", "word", "n", "known", "base", "score", "lattice"])

    return run


def _priced(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, lattice = batch.column(1).to_numpy().astype(float), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3), pa.array(model.base_log(c)), pa.array(model.word_log(c, lattice))], names=["word", "n", "n_all", "lattice", "base", "score"])

    return run


def counts_of(words: DataFrame) -> DataFrame:
    """How many words occur how often, from 100,000 times on taken together."""
    return words.groupBy(F.least("n_all", F.lit(100_000)).alias("times")).agg(F.count(F.lit(1)).alias("kinds"))


def lattice_scores(docs: DataFrame, vocabulary_path: str, training: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    ``training`` names a boolean column: rows to learn from.  Words are maximal runs
    without space, tab or line ends, A-Z taken as a-z; each text ends with one end
    token.  Scores are log10 probabilities of whole texts: ``base_score`` of smoothed
    word frequencies, ``score`` of the lattice model, ``lattice_score`` of its
    segmentations alone, without arcs for seen words.  Null counts as empty text;
    repeated rows are rows of their own; without training rows the lattice has its
    first weights only; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark, rows=1000)
    texts = docs.select(F.coalesce(F.col(training), F.lit(False)).alias("training"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counts = texts.mapInArrow(_word_counts, "word binary, n long, n_all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
    counts = cut(counts, "words")
    f = counts.agg(F.sum("n"), F.sum(F.expr("cast(n > 0 as long)")), F.sum(F.expr("cast(n = 1 as long)")), F.sum(F.expr("cast(n = 2 as long)"))).first()
    n_texts = texts.filter("training").count()
    model = Model(f[0] or 0, n_texts, f[1] or 0, f[2] or 0, f[3] or 0)
    _, _, begin, inner = vocabulary(vocabulary_path)
    prior, split = PRIOR * np.exp(np.concatenate([begin, inner])), len(begin)
    for _ in range(ROUNDS if model.words else 0):
        uses = prior.copy()
        # At most one row for each piece of the fixed vocabulary.
        for r in counts.filter("n > 0").select("word").mapInArrow(_expected(vocabulary_path, begin, inner), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] += r["uses"]
        begin, inner = np.split(np.log(uses / uses.sum()), [split])
    priced = cut(counts.mapInArrow(_marginal(vocabulary_path, begin, inner), "word binary, n long, n_all long, lattice double").mapInArrow(_priced(model), "word binary, n long, n_all long, lattice double, base double, score double"), "priced")
    release(counts)
    # How often a word must occur to be among the head; the histogram has at most 100,000 rows.
    often = sorted((r[0], r[1]) for r in counts_of(priced).collect())
    least, room = 0, head_words
    for times, kinds in reversed(often):
        room -= kinds
        if room < 0:
            break
        least = times
    top = priced.filter(F.col("n_all") >= least).toArrow() if least else priced.limit(0).toArrow()
    words = top["word"].combine_chunks() if top.num_rows else pa.array([], pa.binary())
    off = np.concatenate([[0], np.cumsum([len(w.as_buffer()) for w in words])]).astype(np.int64)
    names = Prefix(np.frombuffer(b"".join(words.to_pylist()), np.uint8), 31, lower=True).of(off[:-1], off[1:])
    head = spark.sparkContext.broadcast((names, top["n"].to_numpy().astype(float), top["lattice"].to_numpy()))
    # The row's number comes with its id: drawn again, it might be another row's.
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = cut(rows.mapInArrow(_scored(model, head), "uid long, doc_id long, word binary, n long, known double, base double, score double, lattice double"), "scored")
    rare = scored.filter("word is not null").select("uid", "word", F.col("n").alias("times")).join(priced.withColumn("lattice", F.col("lattice") / math.log(10)), "word")
    more = [F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_2"), *[F.sum(F.col(c) * F.col("times")).alias(f"{c}_2") for c in ("base", "score", "lattice")]]
    out = scored.filter("word is null").join(rare.groupBy("uid").agg(*more), "uid", "left")
    whole = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_2"), F.lit(0.0))
    known = whole("known").cast("long") + F.lit(int(model.texts > 0))
    return out.select(
        "doc_id", (F.col("n") + 1).alias("n_tokens"), known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (whole("base") + F.lit(model.base_end)).alias("base_score"), (whole("score") + F.lit(model.end)).alias("score"),
        (whole("lattice") + F.col("n") * F.lit(model.on) + F.lit(model.end)).alias("lattice_score"),
    )


def op2_lattice_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all whole ``documents`` texts, learned from nine folds in ten."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", is_held_out("doc_id", 10))
    scores = lattice_scores(docs.withColumn("training", ~F.col("held_out")), public_tokenizers.path("piece_bpe_32k.model"), "training")
    return scores.select("doc_id", is_held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
