"""Vectorised hashing of UTF-8 text held in Arrow buffers.

A prefix sum of ``T[byte] * B**i`` modulo 2**64 (random table ``T``, odd ``B``)
gives the hash of any substring from two array reads.  Two independent
functions together serve as a 128-bit name where equality must be trusted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .worker import drops

U64 = np.uint64
SLICE_BYTES = 1 << 18

#: Multipliers of the splitmix64 finaliser.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


@functools.cache
def byte_table(seed: int, lower: bool) -> np.ndarray:
    """Random 64-bit value for each byte; with ``lower``, A-Z share those of a-z."""
    table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U64)
    if lower:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(np.random.default_rng(seed + 1).integers(0, 1 << 62)) * 8 + 3
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.empty(size, U64)
        p[0] = 1
        n = 1
        while n < size:
            m = min(n, size - n)
            p[n : n + m] = p[:m] * U64(pow(b, n, 1 << 64))
            n += m
        out.append(p)
    return out[0], out[1]


drops(_powers.cache_clear)


class Prefix:
    """Substring hashes over one array of bytes."""

    def __init__(self, data: np.ndarray, seed: int, lower: bool = False):
        size = max(SLICE_BYTES, 1 << max(1, len(data)).bit_length()) + 1
        up, self.down = _powers(seed, size)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(byte_table(seed, lower)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hash of bytes ``start`` to ``end`` (excluded) for each pair."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * MIX_B)

    def every(self, length: int) -> np.ndarray:
        """Scrambled hash of the ``length`` bytes from each place where they fit."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows as (first row, last row excluded, their bytes, offsets into those bytes).

    A slice holds about ``max_bytes``, or one longer text.  Null counts as empty.
    """
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "" if pa.types.is_large_string(texts.type) else b"")
    if pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[off[row] : off[stop]], off[row : stop + 1] - off[row]
        row = stop


class Index:
    """Positions of distinct 64-bit keys.

    Keys that find their slot taken go to a further table, so a key is in none of
    the later ones once its slot is free.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, keys, at = [], keys.astype(U64), np.arange(len(keys))
        while len(keys):
            bits = max(4, int(4 * len(keys)).bit_length())
            shift, factor = U64(64 - bits), MIX_A if len(self.levels) % 2 else MIX_B
            factor = U64((int(factor) + 2 * len(self.levels)) % (1 << 64))
            slot = (keys * factor) >> shift
            held, value = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int64)
            held[slot], value[slot] = keys, at
            self.levels.append((factor, shift, held, value))
            lost = held[slot] != keys
            keys, at = keys[lost], at[lost]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for none."""
        out, waiting = np.full(len(keys), -1, np.int64), None
        for factor, shift, held, value in self.levels:
            mine = keys if waiting is None else keys[waiting]
            slot = (mine * factor) >> shift
            got = value[slot]
            hit = held[slot] == mine
            if waiting is None:
                out = np.where(hit, got, -1)
                waiting = np.flatnonzero(~hit & (got >= 0))
            else:
                out[waiting[hit]] = got[hit]
                waiting = waiting[~hit & (got >= 0)]
            if not len(waiting):
                break
        return out


#: The bytes that part words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that don't part words; runs end with their row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[: len(data)] = ~SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = inside[:-1] & (~inside[1:] | first[1:])
    return np.flatnonzero(begin), np.flatnonzero(end)
