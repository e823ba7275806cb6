"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: for ``t`` coordinates there are ``2 t`` rounds.  In each of the first
``t`` rounds every shingle falls into one hashed bin with a hashed value; in
round ``t + i`` every shingle falls into bin ``i``.  A bin keeps its smallest
(round, value), so earlier rounds win and every bin is full at the end, whatever
the set's size; the work is about ``t log t + n`` rather than ``t n``.

Bands of four coordinates name buckets.  Equal sets are one class before
banding.  A bucket isn't expanded into pairs: its members are compared with one
hub, verified links merge classes into components, and only members that are
still in different components of a bucket are compared again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut
from .bytehash import U64, Prefix, mix, slices, word_bounds
from .components import connected_components
from .worker import claim

WORDS, COORDINATES, BAND = 5, 160, 4
PERCENT = 75

_STEP = U64(0x9E3779B97F4A7C15)  # fixed value: the increment of splitmix64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles.

    Words are maximal runs without space, tab or line ends, A-Z taken as a-z.
    A text of fewer words has its whole sequence as one shingle; without words
    or text the set is empty.
    """
    for lo, hi, data, off in slices(texts):
        start, end = word_bounds(data, off)
        names = Prefix(data, 11, lower=True).of(start, end)
        firsts = np.searchsorted(start, off[:-1])
        lasts = np.append(firsts[1:], len(start))
        n = len(names) - words + 1
        joined = names[: max(n, 0)].copy()
        for k in range(1, words):
            joined = mix(joined * _STEP + names[k : k + max(n, 0)])
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            if b - a >= words:
                yield np.unique(joined[a : b - words + 1])
            elif b > a:
                h = np.array([b - a], U64)
                for w in names[a:b]:
                    h = mix(h * MIX_SHORT + w)
                yield h
            else:
                yield np.zeros(0, U64)


MIX_SHORT = U64(0xD6E8FEB86659FD93)  # fixed value: an odd multiplier


@functools.cache
def _seeds(t: int) -> np.ndarray:
    return np.random.default_rng(2017).integers(0, 1 << 64, 2 * t, dtype=U64)


def sketch(members: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes."""
    seeds, out = _seeds(t), np.full(t, np.iinfo(np.int64).max, np.int64)
    low, at = U64(0xFFFFFFFF), 0
    chunk = max(1, 4 * t // len(members))
    while at < t:
        rounds = np.arange(at, min(t, at + chunk))
        v = mix(members[None, :] ^ seeds[rounds][:, None])
        bins = ((v >> U64(32)) * U64(t) >> U64(32)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((rounds[:, None] << 32) | (v & low).astype(np.int64)).ravel())
        at += len(rounds)
        if out.max() != np.iinfo(np.int64).max:
            return out
    for i in np.flatnonzero(out == np.iinfo(np.int64).max):
        out[i] = (t + int(i)) << 32 | int((mix(members ^ seeds[t + i]) & low).min())
    return out


def band_names(coordinates: np.ndarray, width: int = BAND) -> np.ndarray:
    """A 64-bit name for each band of ``width`` coordinates; the band's number is part of it."""
    rows = coordinates.reshape(-1, width).astype(U64)
    h = np.arange(1, len(rows) + 1, dtype=U64) * _STEP
    for k in range(width):
        h = mix(h + rows[:, k] * MIX_SHORT)
    return h.view(np.int64)


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("minhash")
    for batch in batches:
        sizes, a, b, bands = [], [], [], []
        for members in shingle_sets(batch.column(1)):
            sizes.append(len(members))
            if len(members):
                a.append(int(mix(members).sum(dtype=U64).view(np.int64)))
                b.append(int(mix(members * MIX_SHORT).sum(dtype=U64).view(np.int64)))
                bands.append(band_names(sketch(members)))
            else:
                a.append(0), b.append(0), bands.append(np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, np.concatenate(bands) if bands else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], schema=_SKETCHED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("minhash")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], names=["doc_id", "members"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, members_a, members_b) whose sets are similar enough."""
    for batch in batches:
        kept = []
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
            if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= PERCENT * (len(both) - shared):
                    kept.append(i)
        yield batch.take(pa.array(kept, pa.int64())).select([0, 1])


BLOCK_BYTES, LANES = 1 << 18, 64


def _cross_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sets against blocks: links between different components.

    Each side is a list of (doc_id, component, members).  Shared counts come
    from one product of 0/1 matrices over the shingles that both blocks have.
    """
    for batch in batches:
        a, b = [], []
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            left, right = left.values, right.values
            ids, comps, sizes, flat, owner = [], [], [], [], []
            for side in (left, right):
                ids.append(side.field("doc_id").to_numpy(zero_copy_only=False))
                comps.append(side.field("component").to_numpy(zero_copy_only=False))
                sets = [np.frombuffer(x.as_buffer(), U64) for x in side.field("members")]
                sizes.append(np.array([len(s) for s in sets]))
                flat.append(np.concatenate(sets))
                owner.append(np.repeat(np.arange(len(sets)), sizes[-1]))
            shared = np.intersect1d(flat[0], flat[1])
            counts = np.zeros((len(ids[0]), len(ids[1])))
            for s in range(0, len(shared), 4096):
                part, ones = shared[s : s + 4096], []
                for k in (0, 1):
                    at = np.minimum(np.searchsorted(part, flat[k]), len(part) - 1)
                    hit = part[at] == flat[k]
                    m = np.zeros((len(ids[k]), len(part)), np.float32)
                    m[owner[k][hit], at[hit]] = 1
                    ones.append(m)
                counts += ones[0] @ ones[1].T
            union = sizes[0][:, None] + sizes[1][None, :] - counts
            found = (100 * counts >= PERCENT * union) & (comps[0][:, None] != comps[1][None, :])
            i, j = np.nonzero(found)
            _, first = np.unique(np.stack([comps[0][i], comps[1][j]]), axis=1, return_index=True) if len(i) else (None, [])
            a += ids[0][i[first]].tolist()
            b += ids[1][j[first]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _missed_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a bucket that the hubs left in different components.

    Hubs have been compared with all their members, so buckets whose other
    members are in one component are done.  For a text x let s(x) be how many of
    its n(x) shingles occur in other components.  A link x, y needs
    7 min(s(x), s(y)) >= 3 (n(x) + n(y)), as 4 I >= 3 (n(x) + n(y) - I) and
    I <= min(s(x), s(y)); with n(y) >= I that is 4 s(x) >= 3 n(x).  Texts that fail
    it can't link and leave; what stays is compared block by block inside each
    connected group of buckets.
    """
    members = buckets.filter("doc_id <> hub").select("key", "doc_id")
    named = members.join(labels, members.doc_id == labels.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_ = cut(named.join(mixed, "key", "left_semi"), "open")
    people = open_.select("doc_id", "component").distinct()
    own = cut(sets.join(people, "doc_id"), "own")
    shingles = own.select("doc_id", "component", F.explode(_as_longs("members")).alias("s"))
    common = shingles.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("s")
    able = shingles.join(common, "s", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shareable"))
    n = (F.octet_length("members") / 8).cast("long")
    able = cut(own.withColumn("n", n).join(able, "doc_id").filter(f"100 * shareable >= {PERCENT} * n").drop("shareable"), "able")
    left = open_.select("key", "doc_id").join(able.select("doc_id", "component", "n"), "doc_id")
    mixed = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("first")).filter("lo <> hi").select("key", "first")
    chained = left.select("key", "doc_id").join(mixed, "key").select("doc_id", "first").distinct()
    groups = connected_components(chained)
    grouped = cut(able.join(groups, able.doc_id == groups.node).select("doc_id", able.component, "members", "n", groups.component.alias("grp")), "grouped")
    # Blocks of like sizes, cut by the counts of each size: a group's texts never meet in one task.
    sizes = grouped.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("grp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    bytes_ = F.col("m") * F.col("n") * 8
    sizes = sizes.select("grp", "n", F.floor(F.coalesce(F.sum(bytes_).over(before), F.lit(0)) / BLOCK_BYTES).alias("block"), F.ceil(bytes_ / BLOCK_BYTES).alias("parts"))
    part = F.when(F.col("parts") == 1, -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    dealt = grouped.join(sizes, ["grp", "n"]).select("grp", "block", F.when(F.col("parts") > 1, F.col("n")).otherwise(0).alias("size"), part.alias("part"), "doc_id", "component", "members", "n")
    packed = dealt.groupBy("grp", "block", "size", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.collect_list(F.struct("doc_id", "component", "members")).alias("texts"))
    packed = cut(packed.select("grp", F.xxhash64("grp", "block", "size", "part").alias("block"), "least", "most", "texts"), "blocks")
    # Blocks of a large group are dealt to lanes and meet all lanes, so that its pairs don't share a key.
    lanes = packed.groupBy("grp").agg(F.least(F.lit(LANES), F.ceil(F.count(F.lit(1)) / 8)).cast("int").alias("lanes"))
    packed = packed.join(lanes, "grp")
    one = packed.withColumn("lane", F.pmod("block", "lanes").cast("int")).drop("lanes")
    other = packed.select("grp", *[F.col(c).alias(f"{c}_2") for c in ("block", "least", "most", "texts")], F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    close = f"block <= block_2 and 100 * most >= {PERCENT} * least_2 and 100 * most_2 >= {PERCENT} * least"
    pairs = one.join(other, ["grp", "lane"]).filter(close).select("texts", "texts_2")
    return pairs.mapInArrow(_cross_links, "a long, b long")


def _as_longs(members: str):
    """The 8-byte values that a binary column joins."""
    n = (F.octet_length(members) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(members), i * 8 + 1, F.lit(8))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when their sets of five-word shingles have a Jaccard
    similarity of 0.75 or more; a component is what links reach, named by its
    smallest id, and that document is kept.  Two texts at exactly 0.75 share no
    band with probability below 3e-7.  Null and wordless texts have empty sets
    and link with nothing; equal texts always link; rows that share an id count
    as one document; an empty table gives an empty result; other columns are
    ignored whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark, rows=500, megabytes=8)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(docs.mapInArrow(_sketched, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "sketched")
    same = ["n_shingles", "set_a", "set_b"]
    full = sketched.filter("n_shingles > 0")
    classes = cut(full.groupBy(*same).agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r")).select(*same, F.col("r.doc_id").alias("rep"), "r.bands"), "classes")
    named = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("doc_id"))
    crowded = named.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "hub")
    buckets = cut(named.join(crowded, "key"), "buckets")
    pairs = cut(buckets.filter("doc_id <> hub").select("hub", "doc_id").distinct(), "pairs")
    people = pairs.select("hub").union(pairs.select("doc_id")).distinct().toDF("doc_id")
    # The same plan at every size: the ids grow with the corpus, so they aren't broadcast where they happen to be few.
    sets = cut(docs.join(people.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, members binary"), "sets")
    both = pairs.join(sets, "doc_id").select("hub", "doc_id", F.col("members").alias("members_x")).join(sets.select(F.col("doc_id").alias("hub"), "members"), "hub").select("hub", "doc_id", "members", "members_x")
    links = cut(both.mapInArrow(_verified, "hub long, doc_id long"), "links")
    labels = cut(connected_components(links), "labels")
    more = _missed_links(buckets, labels, sets)
    merged = links.toDF("a", "b").unionByName(more)
    labels = cut(connected_components(merged), "labels")
    reps = classes.select(*same, "rep").join(labels, classes.rep == labels.node, "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", *same).join(reps, same, "left").withColumn("component_id", F.least(F.coalesce("component_id", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all whole ``documents`` texts."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
