"""Removal of repeated byte strings by bucket-pointer refinement.

Every string of ``length`` bytes that starts at two places is to be found,
without sorting every suffix.  Suffixes start out in buckets of equal q-grams.
A bucket is refined by the identifiers of buckets at later (and, as the q-gram
lies inside the string, earlier) offsets; identifiers are 128-bit names of the
bytes they cover, so machines agree on them without talking, and one prefix sum
per text yields the identifier at any offset and depth, so what a round has
named is reused by the next.  Buckets of one leave at once.

* Round 0: each string of ``length`` bytes is represented by its leftmost
  smallest q-gram, its anchor, so equal strings have equal anchors at equal
  offsets, and neighbouring strings share one.  Anchors are bucketed by q-gram,
  then refined by the identifier of all bytes that their strings cover.  An
  anchor that agrees with another in this is repeated with all its strings.
* Round 1: the strings of other anchors are taken by fixed ranges of offsets.
  The bytes that all strings of a range share give the bucket, those that any of
  them covers refine it.
* Round 2: the strings of ranges that neither settled are named one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut, release
from .bytehash import MIX_A, U64, Prefix, mix, slices, word_bounds
from .worker import claim

LENGTH, GRAM, RANGE = 400, 160, 24
#: A passage of this many words is repeated if it stands twice; bytes of a word's name.
WORDS, NAME = 51, 8
SEGMENT = 1 << 20
_INDEX_BITS = U64((1 << 24) - 1)


def _segments(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte offset in that row, bytes, offsets); a long text comes in parts that share ``length - 1`` bytes."""
    for lo, hi, data, off in slices(texts):
        if len(data) <= SEGMENT:
            yield lo, 0, data, off
        else:
            for s in range(0, max(1, len(data) - length + 1), SEGMENT):
                part = data[s : s + SEGMENT + length - 1]
                yield lo, s, part, np.array([0, len(part)])


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: row, first and last start, anchor, and their identifiers."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none, none
    one, two, width = Prefix(data, 5), Prefix(data, 6), length - gram + 1
    names = one.every(gram)
    least, span = (names & ~_INDEX_BITS) | np.arange(len(names), dtype=U64), 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & _INDEX_BITS).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(row[: len(anchor)] == row[length - 1 : length - 1 + len(anchor)])
    if not len(start):
        return none, none, none, none, none, none, none
    at = anchor[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    at, first, last = at[new], start[new], start[np.r_[new[1:], len(start)] - 1]
    place = (at - first).astype(U64) * MIX_A
    full = [mix(p.of(first, last + length) + place).view(np.int64) for p in (one, two)]
    return row[first], first, last, at, names[at].view(np.int64), full[0], full[1]


_ANCHORS = "id long, hash long, first long, last long, at long, core long, fa long, fb long"


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, base, data, off in _segments(batch.column(2), length):
                row, first, last, at, core, fa, fb = anchors(data, off, length, gram)
                shift = base - off[row]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[lo + row], hashes[lo + row], first + shift, last + shift, at + shift, core, fa, fb)], names=_ANCHORS.replace(" long", "").split(", "))

    return run


def _contexts(length: int):
    """Bytes that the open strings of each anchor cover, cut out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                for a in batch.column(3)[i].values.to_pylist():
                    for column, value in zip(out, (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), a["first"], a["last"], a["at"], text[a["first"] : a["last"] + length].to_pybytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], names=["id", "hash", "first", "last", "at", "bytes"])

    return run


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), off


def _ranged(length: int, width: int):
    """Round 1: for each range of offsets from an anchor, bucket and refinement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, first, last, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            data, off = _joined(batch.column(5))
            low, high = at - last, at - first  # the offsets from a string's start to its anchor
            k = [np.arange(a // RANGE, b // RANGE + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            i = np.repeat(np.arange(len(k)), [len(x) for x in k])
            k = np.concatenate(k) if k else np.zeros(0, np.int64)
            near, far = k * RANGE, np.minimum(k * RANGE + RANGE - 1, width - 1)
            lo, hi = np.maximum(near, low[i]), np.minimum(far, high[i])
            shift = off[i] + at[i] - first[i]
            one, two = Prefix(data, 5), Prefix(data, 6)
            core = mix(one.of(shift - near, shift - far + length) + near.astype(U64) * MIX_A)
            place = (lo * 4096 + hi).astype(U64) * MIX_A
            full = [mix(p.of(shift - hi, shift - lo + length) + place) for p in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[i], hashes[i], at[i] - hi, at[i] - lo, at[i], core.view(np.int64), full[0].view(np.int64), full[1].view(np.int64))], names=_ANCHORS.replace(" long", "").split(", "))

    return run


def _single(length: int):
    """Round 2: one identifier for each string of the ranges still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, first = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            data, off = _joined(batch.column(3))
            starts, rows = [], []
            for i, ranges in enumerate(batch.column(4)):
                for r in ranges.values.to_pylist():
                    if not first[i] <= r["first"] <= r["last"] <= first[i] + off[i + 1] - off[i] - length:
                        continue  # of the other part of a text that was read in parts
                    starts.append(np.arange(r["first"], r["last"] + 1))
                    rows.append(np.full(len(starts[-1]), i))
            start, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, rows))
            at = off[i] + start - first[i]
            names = [Prefix(data, s).of(at, at + length).view(np.int64) for s in (5, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[i], hashes[i], start, *names)], names=["id", "hash", "first", "fa", "fb"])

    return run


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rows`` that agree with another in all they cover, and those to refine.

    The latter are rows that agree with none but share their bucket, with one row
    for each group of agreeing rows in such a bucket, for they can still hold the
    partners of the former.
    """
    # A table of its own, so that the join can split a bucket that many rows share.
    company = cut(rows.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("core"), "company")
    rows = cut(rows.join(company, "core", "left_semi"), "bucketed")
    place = F.struct("id", "hash", "first", "last", "at")
    classes = cut(rows.groupBy("core", "fa", "fb").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "classes")
    done = rows.join(classes.filter("n > 1").select("core", "fa", "fb"), ["core", "fa", "fb"], "left_semi").select("id", "hash", "first", "last")
    alone = classes.filter("n = 1").select("core").distinct()
    refine = classes.join(alone, "core", "left_semi").select("one.*")
    release(company)
    return done, refine


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, as_words: bool = False) -> DataFrame:
    """(id, hash, first, last): starts of repeated strings, as ranges, of texts (id, hash, text).

    With ``as_words`` the strings are those of the names of the texts' words.
    """
    # One Python function a stage: each would have a worker of its own.
    anchored, contexts_of = _anchored(length, gram), _contexts(length)
    raw = cut(keyed.mapInArrow((lambda batches: anchored(_named(batches))) if as_words else anchored, _ANCHORS), "anchors")
    round0, refine = _settle(raw)
    release(raw)
    refine = refine.groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last", "at")).alias("open"))
    texts = keyed.join(refine, ["id", "hash"]).select("id", "hash", F.col("text").cast("binary").alias("text"), "open")
    contexts = cut(texts.mapInArrow((lambda batches: contexts_of(_named(batches))) if as_words else contexts_of, "id long, hash long, first long, last long, at long, bytes binary"), "contexts")
    round1, refine = _settle(contexts.mapInArrow(_ranged(length, length - gram + 1), _ANCHORS))
    ranges = refine.groupBy("id", "hash", "at").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    left = contexts.join(ranges, ["id", "hash", "at"]).select("id", "hash", "first", "bytes", "ranges")
    single = cut(left.mapInArrow(_single(length), "id long, hash long, first long, fa long, fb long"), "single")
    # A table of its own, for the same reason as in _settle.
    twice = cut(single.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fa", "fb"), "twice")
    last = single.join(twice, ["fa", "fb"], "left_semi").select("id", "hash", "first", F.col("first").alias("last"))
    return round0.unionByName(round1).unionByName(last)


def _removed(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column(0)[i].as_buffer(), np.uint8)
                found = batch.column(1)[i]
                kept, n = text.tobytes(), 0
                if found.is_valid and len(found.values):
                    change = np.zeros(len(text) + 1, np.int64)
                    np.add.at(change, found.values.field("first").to_numpy(), 1)
                    np.add.at(change, found.values.field("last").to_numpy() + length, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    n = int((gone & ~np.r_[False, gone[:-1]]).sum())
                    kept = text[~gone].tobytes()
                for column, value in zip(out, (len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None), strict=True):
                    column.append(value)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())] + [pa.array(out[3], pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text, *batch.schema.names[2:]])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with what is left of each text.

    Added: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, with ``keep_text``, ``kept_text`` (bytes of characters
    cut in two are left out of it; the digest is of all bytes left).  They
    replace columns of the same names.  Texts are UTF-8 bytes and matches never
    cross them.  Null counts as empty; texts shorter than ``length`` stay whole;
    repeated rows are separate texts and so remove each other; strings are
    judged on the input; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession, rows=500, megabytes=8)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text]
    carried = [c for c in docs.columns if c not in added]
    inner = docs.select([docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(carried)])
    text = F.coalesce(F.col(f"_c{carried.index(text_col)}").cast("string"), F.lit(""))
    inner = inner.withColumn("text", text).withColumn("id", F.coalesce(F.col(f"_c{carried.index(id_col)}").cast("long"), F.lit(-1))).withColumn("hash", F.xxhash64("text"))
    spans = repeated_spans(inner.select("id", "hash", "text"), length, gram).groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    others = [c for c in inner.columns if c.startswith("_c") and c != f"_c{carried.index(text_col)}"]
    original = [f"_c{carried.index(text_col)}"] if keep_text else []
    joined = inner.join(spans, ["id", "hash"], "left").select(F.col("text").cast("binary").alias("text"), "found", F.octet_length("text").cast("long").alias("n_bytes"), *others, *original)
    schema = ", ".join(["n_removed long", "n_spans long", "kept_sha256 string", *["kept_text string"] * keep_text, "n_bytes long", *[f"{c} {joined.schema[c].dataType.simpleString()}" for c in [*others, *original]]])
    out = joined.mapInArrow(_removed(length, keep_text), schema)
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carried) if keep_text or c != text_col]
    return out.select(*back, *added)


def passage_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of UTF-8 texts: what white space parts, and each kana or ideograph."""
    start, end = word_bounds(data, off)
    after = np.r_[data[1:], np.uint8(0)]
    three = ((data >= 0xE4) & (data <= 0xE9)) | ((data == 0xE3) & (after >= 0x81))
    four = (data == 0xF0) & (after >= 0xA0) & (after < 0xC0)
    if not (three.any() or four.any()):
        return start, end
    begins = np.zeros(len(data) + 5, bool)
    begins[start] = True
    for at, size in ((np.flatnonzero(three), 3), (np.flatnonzero(four), 4)):
        begins[at] = True
        run = np.searchsorted(start, at, "right") - 1
        begins[(at + size)[at + size < end[run]]] = True
    every = np.flatnonzero(begins)
    return every, np.minimum(end[np.searchsorted(start, every, "right") - 1], np.r_[every[1:], len(data)])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the 64-bit names of their words, one after the other."""
    claim("repeats")
    for batch in batches:
        flat, sizes = [], []
        for _, _, data, off in slices(batch.column(2)):
            start, end = passage_words(data, off)
            lo = 0
            while lo < len(start):
                hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SEGMENT, "right")))
                a = start[lo]
                flat.append(Prefix(data[a : end[hi - 1]], 7).of(start[lo:hi] - a, end[lo:hi] - a))
                lo = hi
            sizes.append(np.diff(np.searchsorted(start, off)))
        names = np.concatenate(flat) if flat else np.zeros(0, U64)
        ends = np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0, np.int64)
        offsets = np.r_[0, ends].astype(np.int64) * NAME
        words = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(names)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, *batch.columns[3:]], names=["id", "hash", "text", *batch.schema.names[3:]])


def _without_passages(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column(0)[i].as_buffer(), np.uint8)
                found, kept = batch.column(1)[i], text
                if found.is_valid and len(found.values):
                    # Names match at whole words only; a removed word goes with the space after it.
                    first, last = -(-found.values.field("first").to_numpy() // NAME), found.values.field("last").to_numpy() // NAME
                    start = np.r_[passage_words(text, np.array([0, len(text)]))[0], len(text)]
                    whole = first <= last
                    change = np.zeros(len(text) + 1, np.int64)
                    np.add.at(change, start[first[whole]], 1)
                    np.add.at(change, start[last[whole] + words], -1)
                    kept = text[np.cumsum(change)[:-1] == 0]
                out.append(kept.tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["kept_text", *batch.schema.names[2:]])

    return run


def remove_passages(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``kept_text``: each text without its repeated passages.

    A passage is a run of ``words`` words or more that stands at two places of the
    table, whatever its bytes and the white space in it.  Texts become the names of
    their words, and so repeated strings of ``NAME * words`` bytes that start with a
    word are repeated passages; texts are otherwise treated as by remove_repeats.
    """
    bound_batches(docs.sparkSession, rows=500, megabytes=8)
    carried = [c for c in docs.columns if c != "kept_text"]
    inner = docs.select([docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(carried)])
    text = F.coalesce(F.col(f"_c{carried.index(text_col)}").cast("string"), F.lit(""))
    inner = inner.withColumn("text", text).withColumn("id", F.coalesce(F.col(f"_c{carried.index(id_col)}").cast("long"), F.lit(-1))).withColumn("hash", F.xxhash64("text"))
    length = NAME * words
    spans = repeated_spans(inner.select("id", "hash", "text"), length, min(GRAM, length), as_words=True).groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    columns = [c for c in inner.columns if c.startswith("_c")]
    joined = inner.join(spans, ["id", "hash"], "left").select(F.col("text").cast("binary").alias("text"), "found", *columns)
    schema = ", ".join(["kept_text string", *[f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns]])
    return joined.mapInArrow(_without_passages(words), schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], "kept_text")


def op7_remove_repeats(spark, sf_dir: str) -> DataFrame:
    """What removing 400-byte repeats leaves of every whole ``documents`` text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
