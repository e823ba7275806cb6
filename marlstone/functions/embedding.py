"""A deterministic embedder that needs no model: hashed words and trigrams."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np

DIMENSIONS = 384
#: Offset and prime of the 64-bit FNV hash.
_OFFSET, _PRIME = 14695981039346656037, 1099511628211


@functools.lru_cache(1 << 16)
def feature_hash(feature: str) -> int:
    h = _OFFSET
    for byte in feature.encode():
        h = ((h ^ byte) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def embed(text: str, dims: int = DIMENSIONS) -> list[float]:
    """Unit vector of a text: words weigh 1, character trigrams a half; bit 40 of the hash is the sign."""
    x = " ".join(text.lower().split())
    # Weights are halves and their sums exact, so that features can be counted first.
    counted = [(Counter(x.split()), "w:", 1.0), (Counter(map("".join, zip(x, x[1:], x[2:]))), "t:", 0.5)]
    h = np.array([feature_hash(kind + name) for names, kind, _ in counted for name in names], np.uint64)
    weights = np.array([n * weight for names, _, weight in counted for n in names.values()])
    v = np.bincount((h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), -weights, weights), dims) if len(h) else np.zeros(dims)
    size = np.linalg.norm(v)
    if not size:
        v[0] = size = 1.0
    return (v / size).astype(np.float32).tolist()


class Embedder(Protocol):
    """Vectors of texts; ``name`` and ``dims`` say which vectors can be compared."""

    name: str
    dims: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """The hashed embedder; a prefix, as models ask for, is put before queries only."""

    dims: int = DIMENSIONS
    prefix: str = ""

    @property
    def name(self) -> str:
        return f"hash-{self.dims}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [embed(t, self.dims) for t in texts]

    def query(self, text: str) -> list[float]:
        return self([self.prefix + text])[0]


def resolve(candidates: list[tuple[str, Callable[[], Embedder]]]) -> tuple[Embedder | None, str]:
    """The first embedder that can be made, and an empty reason; else None and why each couldn't."""
    why = []
    for name, make in candidates:
        try:
            return make(), ""
        except Exception as error:  # noqa: BLE001 - the reason is reported, search goes on without vectors
            why.append(f"{name}: {error}")
    return None, "; ".join(why) or "no embedder given"
