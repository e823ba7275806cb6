"""Merge-type subword encoding with seeded dropout, and decoding.

Text is parted into runs of spaces with what follows them; spaces become the mark
of the vocabulary and, as its model asks, one mark is put before the text.  In
each part an agenda holds the neighbours whose joint string is a piece; the best
ranked (leftmost if equal) is merged, until none is left.  With dropout a keyed
hash of the seed, the part's place, the candidate's place in it and its piece says
whether the candidate is skipped, so that another run gives the same pieces and
another seed others.  What is no piece falls back to bytes, and so does a literal
mark, so every sequence decodes to its text.

Agendas of many parts are processed at once, one merge in each at a time; a part
of more than ``WIDE`` characters has a heap of its own, so that its cost grows
with its length times the logarithm.  With dropout every part of every document
has its own hashes and its own agenda; without, equal parts are worked out once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches
from .bytehash import MIX_A, MIX_B, U64, Index, Prefix, mix, slices
from .worker import claim, drops

DROPOUT, SEED = 0.1, 20
MARK, WIDE = "▁", 512
_SPACE, _BATCH = 0x20, 1 << 19
_NONE = np.int64(1 << 40)


class Merges:
    """Pairs of symbols whose joint string is a piece, with its number and rank."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        usual = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in usual}
        number = {t: i for i, t in text.items()}
        # Symbols are pieces, or characters without a piece of their own.
        self.symbols = dict(number)
        for t in text.values():
            for ch in t:
                self.symbols.setdefault(ch, self.size + len(self.symbols))
        order = sorted(usual, key=lambda i: (-model.get_score(i), i))
        rank_of = {i: r for r, i in enumerate(order)}
        pairs = sorted((self.symbols[t[:k]] << 20 | self.symbols[t[k:]], rank_of[i], i) for i, t in text.items() for k in range(1, len(t)) if t[:k] in self.symbols and t[k:] in self.symbols)
        self.pairs, self.ranks, self.joint = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.index = Index(self.pairs.view(U64))
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        chars = np.full(0x110000, -1, np.int64)
        for t, s in self.symbols.items():
            if len(t) == 1 and t != MARK:
                chars[ord(t)] = s
        chars[_SPACE] = self.symbols[MARK]
        chars[ord(MARK)] = -1
        self.chars = chars
        self.strings = [text[i].replace(MARK, " ").encode() if i in text else b"" for i in range(self.size)]
        for b, i in enumerate(self.byte_ids):
            self.strings[i] = bytes([b])
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in self.strings])])
        self.flat = np.frombuffer(b"".join(self.strings), np.uint8)

    @functools.cached_property
    def by_pair(self) -> dict[int, tuple[int, int]]:
        """Rank and joint piece of each pair, for one lookup at a time."""
        return dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.joint.tolist(), strict=True), strict=True))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` for no pair) and joint piece of neighbours."""
        key = np.where((left >= 0) & (right >= 0), left << 20 | np.maximum(right, 0), -1)
        at = self.index.find(key.view(U64))
        return np.where(at >= 0, self.ranks[at], _NONE), self.joint[at]


class Memo:
    """Pieces of parts that were met before, up to a bound on their number."""

    MOST = 1_000_000

    def __init__(self):
        self.keys, self.at, self.n, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """``keys`` ascending and new, with their numbers of pieces and the pieces one after the other."""
        if len(self.keys) + len(keys) > self.MOST:
            self.__init__()
        where, starts = np.searchsorted(self.keys, keys), len(self.flat) + np.cumsum(counts) - counts
        self.keys, self.at, self.n = (np.insert(old, where, new) for old, new in ((self.keys, keys), (self.at, starts), (self.n, counts)))
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])


_MEMOS: dict[tuple, Memo] = {}
drops(_MEMOS.clear)


@functools.cache
def merges(path: str) -> Merges:
    """This process's merges of a vocabulary file."""
    return Merges(path)


def _keyed(seed: int) -> np.uint64:
    return U64(seed * int(MIX_A) % (1 << 64))


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    h = mix(key + place.astype(U64) * MIX_A + piece.astype(U64) * MIX_B)
    return h < U64(min(int(dropout * 2.0**64), (1 << 64) - 1))


def run_heap(rule: Merges, symbols: np.ndarray, key: np.uint64, dropout: float) -> np.ndarray:
    """What ``run_agendas`` makes of one row without end marks, for long rows."""
    sym, n = symbols.tolist(), len(symbols)
    after, before, pairs = [*range(1, n), -1], list(range(-1, n - 1)), rule.by_pair
    heap: list[tuple[int, int, int, int, int]] = []

    def look(at: int) -> None:
        to = after[at]
        if to >= 0 and sym[at] >= 0 and sym[to] >= 0:
            hit = pairs.get(sym[at] << 20 | sym[to])
            if hit and not (dropout and _skipped(key, np.array([at]), np.array([hit[1]]), dropout)[0]):
                heapq.heappush(heap, (hit[0], at, hit[1], sym[at], to))

    if n > 1:
        left, right = symbols[:-1], symbols[1:]
        ranks, joints = rule.find(left, right)
        if dropout:
            ranks = np.where((ranks < _NONE) & _skipped(key, np.arange(n - 1), joints, dropout), _NONE, ranks)
        heap += [(int(ranks[i]), i, int(joints[i]), sym[i], i + 1) for i in np.flatnonzero(ranks < _NONE).tolist()]
        heapq.heapify(heap)
    # An entry is out of date if either of its symbols has changed since; a symbol that grows gets another number.
    while heap:
        _, at, joint, was, to = heapq.heappop(heap)
        if sym[at] != was or after[at] != to or pairs.get(was << 20 | max(sym[to], 0), (0, -1))[1] != joint:
            continue
        sym[at], sym[to], after[at] = joint, -3, after[to]
        if after[to] >= 0:
            before[after[to]] = at
        look(at)
        if before[at] >= 0:
            look(before[at])
    return np.array(sym, np.int64)


def run_agendas(rule: Merges, symbols: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
    """Merge rows of symbols (-1: no symbol to merge, -2: end) to the last; merged-away places are -3."""
    n, width = symbols.shape
    out, slots = symbols.copy(), np.tile(np.arange(width), (n, 1))
    rank = np.full((n, max(width - 1, 1)), _NONE)
    joint = np.zeros((n, max(width - 1, 1)), np.int64)

    def look(rows: np.ndarray, cols: np.ndarray) -> None:
        r, j = rule.find(now[rows, cols], now[rows, cols + 1])
        if dropout:
            r = np.where((r < _NONE) & _skipped(keys[rows], slots[rows, cols], j, dropout), _NONE, r)
        rank[rows, cols], joint[rows, cols] = r, j

    now = symbols.copy()
    if width > 1:
        rows, cols = (x.ravel() for x in np.indices((n, width - 1)))
        look(rows, cols)
    live = np.arange(n)
    final = [(live, now, slots)] if width < 2 else []
    while width > 1 and len(live):
        best = rank.argmin(axis=1)
        some = rank[np.arange(len(live)), best] < _NONE
        if not some.all():
            final.append((live[~some], now[~some], slots[~some]))
            live, now, slots, rank, joint, best, keys = (x[some] for x in (live, now, slots, rank, joint, best, keys))
            if not len(live):
                break
        rows = np.arange(len(live))
        now[rows, best] = joint[rows, best]
        shift = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
        shift = np.minimum(shift, width - 1)
        now, slots = np.take_along_axis(now, shift, 1), np.take_along_axis(slots, shift, 1)
        now[:, -1] = -2
        # Behind the merged place candidates move up by one; the two that touch it are looked up.
        rank, joint = (np.take_along_axis(x, np.minimum(shift[:, :-1], width - 2), 1) for x in (rank, joint))
        rank[:, -1] = _NONE
        for side in (best - 1, best):
            ok = np.flatnonzero((side >= 0) & (side < width - 1))
            look(ok, side[ok])
    out[:] = -3
    for who, symbols_, slots_ in final:
        r, c = np.nonzero(symbols_ > -2)
        out[who[r], slots_[r, c]] = symbols_[r, c]
    return out


def encode_slice(rule: Merges, data: np.ndarray, off: np.ndarray, row_keys: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of all texts of a slice one after the other, and how many each has."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    off = np.minimum(heads[off], len(points))
    rows = len(off) - 1
    filled = np.flatnonzero(np.diff(off))
    points = np.insert(points, off[filled], _SPACE)  # the mark before a text
    size = np.diff(off) + (np.diff(off) > 0)
    off = np.concatenate([[0], np.cumsum(size)])
    space = points == _SPACE
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[off[:-1][filled]] = True
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, len(points)))
    owner = np.searchsorted(off, start, "right") - 1
    place = np.arange(len(start)) - np.searchsorted(start, off[owner])
    if dropout:
        n, ids = _worked_out(rule, points, start, length, mix(row_keys[owner] + place.astype(U64) * MIX_A + _keyed(seed)), dropout)
        return ids, np.bincount(owner, n, rows).astype(np.int64)
    names = Prefix(points.astype("<u4").view(np.uint8), 41).of(start * 4, (start + length) * 4)
    whole, first, inverse = np.unique(names, return_index=True, return_inverse=True)
    counts = np.zeros(len(whole), np.int64)
    memo = _MEMOS.setdefault((id(rule),), Memo())
    known = memo.find(whole)
    fresh = np.flatnonzero(known < 0)
    new_counts, new_flat = _worked_out(rule, points, start[first[fresh]], length[first[fresh]], whole[fresh], dropout)
    # Old pieces first, then new ones: one array that every part points into.
    old = np.flatnonzero(known >= 0)
    pool, begin_at = memo.flat, np.zeros(len(whole), np.int64)
    counts[old], begin_at[old] = memo.n[known[old]], memo.at[known[old]]
    counts[fresh], begin_at[fresh] = new_counts, len(pool) + np.cumsum(new_counts) - new_counts
    n, at = counts[inverse], begin_at[inverse]
    spots = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    ids = np.empty(len(spots), np.int64)
    late = spots >= len(pool)
    ids[~late], ids[late] = pool[spots[~late]], new_flat[spots[late] - len(pool)]
    memo.add(whole[fresh], new_counts, new_flat)
    return ids, np.bincount(owner, n, rows).astype(np.int64)


def _worked_out(rule: Merges, points: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """How many pieces each part has, and the pieces one after the other; parts of like width run together."""
    counts, order, lo = np.zeros(len(start), np.int64), np.argsort(length, kind="stable"), 0
    sizes, parts, flats = length[order], [], []
    wide = int(np.searchsorted(sizes, WIDE, "right"))
    for k in order[wide:].tolist():
        cps = points[start[k] : start[k] + length[k]][None, :]
        flat, counts[[k]] = _with_bytes(rule, run_heap(rule, rule.chars[cps[0]], keys[k], dropout)[None, :], cps)
        parts.append(np.array([k]))
        flats.append(flat)
    order, sizes = order[:wide], sizes[:wide]
    while lo < len(order):
        width = int(sizes[lo])
        most = width if width < 16 else width + max(4, width // 4)
        hi = min(int(np.searchsorted(sizes, most, "right")), lo + max(1, (1 << 20) // most))
        part = order[lo:hi]
        width = int(sizes[hi - 1])
        inside = np.arange(width)[None, :] < length[part][:, None]
        cps = np.where(inside, points[np.minimum(start[part][:, None] + np.arange(width)[None, :], len(points) - 1)], 0)
        merged = run_agendas(rule, np.where(inside, rule.chars[cps], -2), keys[part], dropout)
        flat, counts[part] = _with_bytes(rule, merged, cps)
        parts.append(part)
        flats.append(flat)
        lo = hi
    if not parts:
        return counts, np.zeros(0, np.int64)
    flat, sequence = np.concatenate(flats), np.concatenate(parts)
    n = counts[sequence]
    begins = np.empty(len(start), np.int64)
    begins[sequence] = np.cumsum(n) - n
    return counts, flat[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


def _with_bytes(rule: Merges, merged: np.ndarray, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of merged rows, bytes for characters without a piece, and how many each row has."""
    r, c = np.nonzero(merged > -2)
    ids = merged[r, c]
    odd = np.flatnonzero((ids < 0) | (ids >= rule.size))
    if not len(odd):
        return ids, np.bincount(r, minlength=len(merged))
    width = np.ones(len(ids), np.int64)
    texts = [chr(cp).encode("utf-8", "surrogatepass") for cp in cps[r[odd], c[odd]].tolist()]
    width[odd] = [len(t) for t in texts]
    out = np.repeat(ids, width)
    at = np.cumsum(width) - width
    spots = np.repeat(at[odd], width[odd]) + np.arange(int(width[odd].sum())) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
    out[spots] = rule.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
    return out, np.bincount(r, width, len(merged)).astype(np.int64)


def decode(rule: Merges, ids: np.ndarray) -> bytes:
    """The text of piece numbers, without the mark that was put before it."""
    n = rule.starts[ids + 1] - rule.starts[ids]
    flat = rule.flat[np.repeat(rule.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    return flat.tobytes()[1:]


def _encoded(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("subword")
        rule = merges(path)
        for batch in batches:
            rows, sizes = [], []
            keys = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) + _keyed(seed))
            for lo, hi, data, off in slices(batch.column(1), _BATCH):
                ids, n = encode_slice(rule, data, off, keys[lo:hi], dropout, seed)
                rows.append(ids.astype(np.int32))
                sizes.append(n)
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32) if sizes else np.zeros(1, np.int32)
            lists = pa.ListArray.from_arrays(off, np.concatenate(rows) if rows else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "ids"])

    return run


def encode_documents(docs: DataFrame, vocabulary_path: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids): the piece numbers of every text.

    The hash of a candidate merge knows the seed, the document's id and the part's
    number in the text, so rows with equal id and text get equal pieces.  Null and
    empty texts have no pieces; a null id counts as 0; with ``dropout`` 0 the
    pieces are those of the vocabulary's own encoder, but for literal marks.
    Parts of any length are encoded whole.
    """
    bound_batches(docs.sparkSession, rows=2000, megabytes=8)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.mapInArrow(_encoded(vocabulary_path, dropout, seed), "key long, text string, doc_id long, ids array<int>").select("doc_id", "text", "ids")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = merges(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            texts, lists = batch.column(1), batch.column(2)
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                ids = flat[off[i] : off[i + 1]]
                back = decode(rule, ids.astype(np.int64))
                text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                for column, value in zip(out, (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back).hexdigest(), back == text), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return run


def op9_encode_dropout(spark, sf_dir: str) -> DataFrame:
    """Every whole ``documents`` text encoded with merge dropout, and what decoding gives."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return coded.mapInArrow(_digest(path), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
