"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies)
the vectors of its letters, permuted by their place; a text's profile bundles
(adds) its trigrams' vectors, and a language's prototype those of its labelled
texts.  A text gets the language whose prototype has the largest cosine with it.

Learning sums trigram counts for each language before anything is bundled, so
what is shuffled is bounded by languages times distinct trigrams; prototypes are
a few kilobytes for each language.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches
from .bytehash import slices
from .worker import claim, drops

DIMENSIONS = 512
_LETTERS = 4096  # letters are told apart modulo this, less the boundary
UNKNOWN = "und"


@functools.cache
def _letter_ids() -> np.ndarray:
    """Code point to letter number; 0 for what is no letter. Case is folded."""
    out = np.zeros(0x110000, np.uint16)
    for cp in range(len(out)):
        ch = chr(cp)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[cp] = 1 + (ord(low) if len(low) == 1 else cp) % (_LETTERS - 1)
    return out


@functools.cache
def _placed_letters(dims: int) -> tuple[np.ndarray, ...]:
    letters = np.random.default_rng(1988).choice(np.array([-1, 1], np.int8), (_LETTERS, dims))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


drops(_placed_letters.cache_clear)


def trigram_vectors(codes: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """The bound vector of each trigram code."""
    first, second, third = _placed_letters(dims)
    return (first[codes >> 24] * second[codes >> 12 & 4095] * third[codes & 4095]).astype(np.float32)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, trigram code, count) of whole UTF-8 texts; a word has a boundary on each side."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    off = np.minimum(heads[off], len(points))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ids = _letter_ids()[points[: len(row)]]
    keep = ids > 0
    keep[1:] |= (ids[:-1] > 0) & (row[1:] == row[:-1])
    ids, row = ids[keep].astype(np.int64), row[keep]
    starts = np.searchsorted(row, np.arange(len(off)))
    places = np.repeat(starts, 2)[1:-1] if len(off) > 1 else np.zeros(0, np.int64)
    owners = np.repeat(np.arange(len(off) - 1), 2)
    ids, row = np.insert(ids, places, 0), np.insert(row, places, owners)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    fits = (row[:-2] == row[2:]) & ((a > 0) | (b > 0)) & ((b > 0) | (c > 0))
    key, count = np.unique((row[:-2] << 36 | a << 24 | b << 12 | c)[fits], return_counts=True)
    return key >> 36, key & ((1 << 36) - 1), count


def profiles(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int, dims: int = DIMENSIONS) -> np.ndarray:
    """Bundled vector of each of ``n`` texts."""
    distinct, at = np.unique(codes, return_inverse=True)
    out = np.zeros((n, dims), np.float32)
    for lo in range(0, n, 256):
        a, b = np.searchsorted(rows, [lo, lo + 256])
        used, where = np.unique(at[a:b], return_inverse=True)
        for s in range(0, len(used), 16384):
            part = (where >= s) & (where < s + 16384)
            dense = np.zeros((min(256, n - lo), min(16384, len(used) - s)), np.float32)
            dense[rows[a:b][part] - lo, where[part] - s] = counts[a:b][part]
            out[lo : lo + 256] += dense @ trigram_vectors(distinct[used[s : s + 16384]], dims)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to trigram counts by language, summed within a batch."""
    claim("langid")
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        index, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary
        keys, sums = [], []
        for lo, hi, data, off in slices(batch.column(1)):
            row, code, count = trigrams(data, off)
            key, at = np.unique(index[lo:hi][row] << 36 | code, return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(at, count))
        if not keys:
            continue
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(sums)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(key >> 36)), pa.array(key & ((1 << 36) - 1)), pa.array(total)], names=["lang", "code", "n"])


def _bundled(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            index, code, n = langs.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                at = index == i
                sums[lang] = sums.get(lang, 0) + n[at].astype(np.float64) @ trigram_vectors(code[at], dims)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims)), pa.array(v)], names=["lang", "i", "v"])

    return run


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from all rows with a language and a text."""
    bound_batches(labelled.sparkSession, rows=1000)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    counts = rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Sums of whole numbers below 2**53, so the order of addition doesn't matter.
    parts = counts.mapInArrow(_bundled(dims), "lang string, i long, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang").agg(F.collect_list(F.struct("i", "v")).alias("vs")).collect():
        v = np.zeros(dims)
        for x in r["vs"]:
            v[x["i"]] = x["v"]
        found[r["lang"]] = v
    names = sorted(k for k, v in found.items() if np.any(v))
    return names, np.array([found[k] / np.linalg.norm(found[k]) for k in names], np.float32).reshape(len(names), dims)


def _predicted(names: list[str], prototypes: np.ndarray, text_at: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for batch in batches:
            langs, scores = [], []
            for lo, hi, data, off in slices(batch.column(text_at)):
                row, code, count = trigrams(data, off)
                found = profiles(row, code, count, hi - lo, dims)
                size = np.linalg.norm(found, axis=1)
                lettered = np.bincount(row, minlength=hi - lo) > 0
                cosine = found @ prototypes.T / np.maximum(size, 1e-9)[:, None] if names else np.zeros((hi - lo, 1))
                best = cosine.argmax(axis=1)
                for i in range(hi - lo):
                    known = bool(names) and lettered[i]
                    langs.append(names[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(cosine[i, best[i]]))) if known else 0.0)
            kept = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(x for i, x in enumerate(batch.schema.names) if i != text_at), "lang_pred", "score"])

    return run


def is_held_out(id_col: str, folds: int) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == 0


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but the text, with ``lang_pred`` and ``score`` (cosine, 0 to 1).

    A null text or one without a letter gets ``und`` and 0, as does every text if
    no language was learned.  Equal cosines go to the first name in order.
    Columns of the added names are replaced.
    """
    bound_batches(docs.sparkSession, rows=1000)
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    inner = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(kept)], docs[f"`{text_col}`"].cast("string").alias("_text"))
    schema = ", ".join([*(f"_c{i} {inner.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(kept))), "lang_pred string", "score double"])
    out = inner.mapInArrow(_predicted(names, prototypes, len(kept), prototypes.shape[1]), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``, learned from four folds in five."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", is_held_out("doc_id", 5))
    names, prototypes = fit(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), names, prototypes).select("doc_id", "held_out", "lang_pred", "score")
