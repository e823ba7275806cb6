"""Vectors from an embeddings table, packed into shards of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "ids binary, vectors binary, n int, d int"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles) of the rows whose id and vector are whole: no nulls, all finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of numbers; shorter ones end with zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(most: int):
    """Rows (id, vector) to rows of at most ``most`` vectors each, within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            d = max(p.shape[1] for p in parts)
            whole = np.concatenate([np.pad(p, ((0, 0), (0, d - p.shape[1]))) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).astype(np.int64).tobytes()]), pa.array([whole.tobytes()]), pa.array([len(whole)], pa.int32()), pa.array([d], pa.int32())], names=["ids", "vectors", "n", "d"])

        for batch in batches:
            all_ids, rows = batch.column(0).to_numpy(), matrix(batch.column(1))
            lo = 0
            while lo < len(rows):
                take = min(most - held, len(rows) - lo)
                ids.append(all_ids[lo : lo + take])
                parts.append(rows[lo : lo + take])
                held, lo = held + take, lo + take
                if held == most:
                    yield flush()
                    ids, parts, held = [], [], 0
        if held:
            yield flush()

    return run


def unpack(ids: pa.Scalar, vectors: pa.Scalar, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), np.float64).reshape(n, d)
