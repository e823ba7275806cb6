"""Best-fit packing of tokenised documents by the linear grouping scheme.

Pieces above ``SMALL`` tokens are sorted and parted into groups of equal
cardinality; all lengths of a group are rounded up to its largest.  With so few
sizes the best mix of configurations (which sizes share a sequence) follows from
a linear programme solved by column generation.  Whole multiples of its
configurations are filled with actual pieces of the groups; the few left over
and all small pieces then go, longest first, where they fit best.

Full pieces are sequences of their own.  The others are dealt by hash to bins of
about ``PER_TASK`` pieces, each packed on its own: every bin sees the same mix of
lengths, so what this costs is less than a sequence or two for each.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut
from .worker import claim, drops

CAPACITY, GROUPS, SMALL, PER_TASK = 2048, 256, 2048 // 3, 25_000
END_ID = 0
_MOST_WORDS = 1_300_000  # about 260 MB
_PROBE = " One two's  THREE\n\n4 five-six, é\t<|x|> seven. 'Tis\r\n  done "


def _little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Token ids of a text, put together from those of its parts between ASCII white space.

    The tokenizer must drop white space and nothing it does may reach across it, so
    that the parts' ids in a row are the text's; one that doesn't is refused.  Ids
    of parts are remembered, up to a bound on their number.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        if self(_PROBE.encode()) != _little_endian(self.tokenizer.encode(_PROBE, add_special_tokens=False).ids):
            raise ValueError(f"{path} doesn't encode words apart from each other")

    def __call__(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.split()
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > _MOST_WORDS:
                known.clear()
                new = list(set(words))
            for lo in range(0, len(new), 2000):
                part = new[lo : lo + 2000]
                for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                    known[w] = _little_endian(e.ids)
        return b"".join(map(known.__getitem__, words))


_ENCODERS: dict[str, WordEncoder] = {}
drops(_ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        encode = encoder(path)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text = batch.column(1)[i]
                tokens = encode(text.as_buffer().to_pybytes() if text.is_valid else b"") + END_ID.to_bytes(4, "little")
                for piece, lo in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[lo : lo + 4 * capacity]
                    for column, value in zip(out, (ids[i], piece, lo // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out[:k], types, strict=False)], names=names[:k])

    return run


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the best basis and how often each is used, in the relaxed problem.

    Prices come from the basis; a configuration worth more than 1 enters it, found
    by a knapsack over at most ``capacity // min(sizes)`` items.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    depth = int(capacity // sizes.min())
    reach = np.arange(capacity + 1)[None, :] - sizes[:, None]
    blocked, reach = reach < 0, np.maximum(reach, 0)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, chosen = np.zeros(capacity + 1), []
        for _ in range(depth):
            offers = value[reach] + price[:, None]
            offers[blocked] = -np.inf
            best = offers.argmax(axis=0)
            gain = offers[best, np.arange(capacity + 1)]
            better = gain > value + 1e-12
            chosen.append(np.where(better, best, -1))
            value = np.where(better, gain, value)
        if value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(chosen):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        level, rate = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(rate > 1e-9, np.maximum(level, 0) / np.where(rate > 1e-9, rate, 1), np.inf)
        leaving = int(ratio.argmin())
        if not np.isfinite(ratio[leaving]):
            break
        basis[:, leaving] = column
    return basis, np.maximum(np.linalg.solve(basis, demand), 0)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; every length is from 1 to ``capacity``."""
    n = len(lengths)
    bin_of, offset, fill = np.full(n, -1, np.int64), np.zeros(n, np.int64), []
    order = np.argsort(-lengths, kind="stable")
    big = order[lengths[order] > small]
    rest = [order[len(big) :]]
    if len(big):
        parts = [p for p in np.array_split(big, min(groups, len(big))) if len(p)]
        sizes, merged = [], []
        for p in parts:
            size = int(lengths[p[0]])
            if sizes and sizes[-1] == size:
                merged[-1] = np.concatenate([merged[-1], p])
            else:
                sizes.append(size)
                merged.append(p)
        basis, used = configurations(np.array(sizes), np.array([len(p) for p in merged], float), capacity)
        queues = [p.tolist() for p in merged]
        for column, times in zip(basis.T.astype(int), np.floor(used + 1e-9).astype(int), strict=True):
            mix = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            for _ in range(times):
                total = 0
                for g in mix:
                    if queues[g]:
                        i = queues[g].pop()
                        bin_of[i], offset[i] = len(fill), total
                        total += int(lengths[i])
                if total:
                    fill.append(total)
        rest.insert(0, np.array([i for q in queues for i in q], np.int64))
    left = np.concatenate(rest)
    left = left[np.argsort(-lengths[left], kind="stable")]
    # Sequences by free room; the bits of ``open_`` say which rooms occur.
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, total in enumerate(fill):
        room[capacity - total].append(b)
        open_ |= 1 << (capacity - total)
    for i in left.tolist():
        need = int(lengths[i])
        fits = open_ >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += need
        room[r - need].append(b)
        open_ |= 1 << (r - need)
    return bin_of, offset


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        bins, offset = pack(table["length"].to_numpy(), capacity)
        place = (table["dealt"].to_numpy().astype(np.int64) << 32) + bins
        return pa.table({"uid": table["uid"], "sequence_id": pa.array(place), "offset": pa.array(offset)})

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``, little-endian).

    A document is its token ids and then id 0; only documents of more than
    ``capacity`` ids are cut.  The tokenizer must encode what ASCII white space parts
    each on its own (``word_bpe_49k.json`` does); another raises ValueError.  Null and empty texts are the one id 0; repeated rows
    are packed one by one; an empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark, rows=1000)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = pieces.filter(F.col("length") < capacity).select("uid", "length")
    deals = max(1, -(-loose.count() // PER_TASK))
    dealt = loose.withColumn("dealt", F.pmod(F.xxhash64("uid"), F.lit(deals)))
    placed = dealt.groupBy("dealt").applyInArrow(_packed(capacity), "uid long, sequence_id long, offset long")
    full = F.col("length") == capacity
    # Full pieces follow the others in the numbering: 2**62 is beyond every deal.
    out = pieces.join(placed, "uid", "left")
    return out.withColumn("sequence_id", F.when(full, F.lit(1 << 62) + F.col("uid")).otherwise(F.col("sequence_id"))).withColumn("offset", F.when(full, F.lit(0).cast("long")).otherwise(F.col("offset"))).drop("uid")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    """All whole ``documents`` packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
