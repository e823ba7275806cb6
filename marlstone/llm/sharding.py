"""Uniform shuffle into shards of exact size by a communication matrix.

Rows lie in blocks.  How many rows each block sends to each shard is drawn from
the multivariate hypergeometric law with the block sizes as row sums and the
shard sizes as column sums, which is the law of those counts under a uniform
permutation.  Each block is then permuted on its own, cut at its counts, the
parts are exchanged, and each shard is permuted again.

Rows pass through DataFrame functions only.  The driver sees one count per
block, and the number of blocks is bounded by ``MAX_BLOCKS`` whatever the input.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

MAX_BLOCKS = 4096
ROWS_PER_BLOCK = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Exact draw: how many of ``drawn`` items, taken without return, are good.

    Inversion that walks outwards from the mode, so the steps are of the order
    of the standard deviation.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    log_p = lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(drawn - mode + 1) - lg(bad - drawn + mode + 1) - lg(good + bad + 1) + lg(drawn + 1) + lg(good + bad - drawn + 1)
    p_up = p_down = math.exp(log_p)
    u = rng.random() - p_up
    up = down = mode
    while u > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            moved = True
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            moved = True
            if u <= 0:
                return down
        if not moved or (p_up < 1e-300 and p_down < 1e-300):
            return mode
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, as a uniform permutation gives them."""
    rng, left, out = random.Random(seed), list(shard_sizes), []
    for n in block_sizes:
        row, need, pool = [], n, sum(left)
        for capacity in left:
            k = hypergeometric(rng, capacity, pool - capacity, need) if need else 0
            row.append(k)
            need, pool = need - k, pool - capacity
        left = [c - k for c, k in zip(left, row, strict=True)]
        out.append(row)
    return out


def _drawn(uid: Column, seed: int) -> Column:
    return F.xxhash64(uid, F.lit(seed))


def hypergeometric_shuffle(df: DataFrame, n_shards: int = 16, seed: int = 17, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Shard sizes differ by one row at most.  Null values, repeated rows and rows
    with equal keys are separate rows and each gets a place.  An empty table
    gives an empty result; with fewer rows than shards some shards stay empty.
    Existing columns ``shard`` and ``slot`` are replaced; every other column,
    whatever its name, is kept.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    inner = [f"_c{i}" for i in range(len(kept))]
    base = cut(df.select([df[f"`{c}`"].alias(i) for c, i in zip(kept, inner, strict=True)]).withColumn("_uid", F.monotonically_increasing_id()), "rows")
    n = base.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // rows_per_block), n or 1))
    blocks = max(blocks, min(16, n or 1))
    placed = base.withColumn("_block", F.pmod(_drawn(F.col("_uid"), seed), F.lit(blocks)).cast("int"))
    sizes = [0] * blocks
    for r in placed.groupBy("_block").count().collect():
        sizes[r["_block"]] = r["count"]
    shards = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    ends = []
    for row in communication_matrix(sizes, shards, seed):
        total, line = 0, []
        for k in row:
            total += k
            line.append(total)
        ends.append(line)
    matrix = spark.range(blocks).select(F.col("id").cast("int").alias("_block"), F.element_at(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>"), (F.col("id") + 1).cast("int")).alias("_ends"))
    local = Window.partitionBy("_block").orderBy(_drawn(F.col("_uid"), seed + 1), "_uid")
    sent = placed.withColumn("_rank", F.row_number().over(local)).join(F.broadcast(matrix), "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
    # The second permutation sorts each shard by a random key; parts of the key's
    # range are ranked apart and shifted by the sizes of the parts before them.
    parts = max(1, min(MAX_BLOCKS, n // n_shards // rows_per_block + 1))
    key = _drawn(F.col("_uid"), seed + 2)
    sent = sent.select("shard", "_uid", *inner, F.pmod(F.shiftright(key, 20), F.lit(parts)).cast("int").alias("_part"), key.alias("_key"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("shard", "_part", "_start")
    within = Window.partitionBy("shard", "_part").orderBy("_key", "_uid")
    # starts has n_shards * parts rows at most, both bounded.
    out = sent.withColumn("_row", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "_part"])
    return out.select(*[F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)], "shard", (F.col("_start") + F.col("_row") - 1).alias("slot"))


def op6_shuffle_shards(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in one of 16 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return hypergeometric_shuffle(narrow, 16).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
