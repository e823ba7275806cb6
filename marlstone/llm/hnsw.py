"""Near-duplicate embeddings over hierarchical navigable small-world graphs.

Each shard has a graph: a vector is in layer 0 and, with probability 1/m for each
further one, in the layers above; in a layer it links to diverse near vectors.
A search descends greedily through the upper layers and keeps a beam in layer 0.
Searches and insertions run for many vectors at once.

Every vector queries every shard.  How wide beams are is settled by audits: near
neighbours at exactly the threshold are made for a sample of the shard's vectors,
and beams widen until enough of them lead back.  A query whose whole beam is
above the threshold repeats with a wider one, so no number of links is cut off.
Links are confirmed by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut
from .components import connected_components
from .vectors import matrix, unpack, usable

THRESHOLD = 0.9
LINKS, BUILD_BEAM, BEAM = 12, 48, 24
SHARD_ROWS, MIN_SHARDS, QUERY_ROWS = 32_768, 4, 512
TASKS, TASK_BLOCKS = 8, 256  # a shard's tasks at least, as far as there are blocks, and blocks of queries in each at most
AUDITS, RECALL = 256, 0.995
_WIDE = 4  # vectors expanded at once for each query


def beam_search(space: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (-1: none) and similarities of each query's beam, best first."""
    q, n = len(queries), len(space)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(q)[:, None]
    found = np.full((q, beam), n, np.int64)
    value = np.full((q, beam), -np.inf, np.float32)
    found[:, 0], value[:, 0] = entry, np.einsum("qd,qd->q", queries, space[entry])
    seen[rows[:, 0], entry] = True
    done = np.full((q, beam), True)
    done[:, 0] = False
    active = np.arange(q)
    while len(active):
        order = np.argsort(done[active], axis=1, kind="stable")[:, :_WIDE]
        fresh = ~np.take_along_axis(done[active], order, 1)
        member = np.where(fresh, np.take_along_axis(found[active], order, 1), n)
        done[active[:, None], order] = True
        near = np.where(member[:, :, None] < n, links[np.minimum(member, n - 1)], n).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        width = int((near < n).sum(axis=1).max(initial=0))
        if width:
            near = np.sort(near, axis=1)[:, :width]
            seen[active[:, None], near] = True
            sims = np.einsum("qd,qkd->qk", queries[active], space[np.minimum(near, n - 1)])
            sims[near == n] = -np.inf
            values, members = np.concatenate([value[active], sims], 1), np.concatenate([found[active], near], 1)
            flags = np.concatenate([done[active], near == n], 1)
            top = np.argsort(-values, axis=1, kind="stable")[:, :beam]
            value[active], found[active], done[active] = (np.take_along_axis(x, top, 1) for x in (values, members, flags))
        active = active[~done[active].all(axis=1)]
    return np.where(value > -np.inf, found, -1), value


def _diverse(space: np.ndarray, points: np.ndarray, found: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` of each point's candidates (best first), skipping those nearer to one already taken."""
    q = len(points)
    taken, count = np.full((q, m), -1, np.int64), np.zeros(q, np.int64)
    kept = np.zeros((q, m, space.shape[1]), np.float32)
    for r in range(found.shape[1]):
        c = found[:, r]
        vectors = space[np.maximum(c, 0)]
        closest = np.where(np.arange(m)[None, :] < count[:, None], np.einsum("qd,qmd->qm", vectors, kept), -np.inf).max(axis=1)
        ok = np.flatnonzero((c >= 0) & (count < m) & (closest < value[:, r]))
        taken[ok, count[ok]], kept[ok, count[ok]] = c[ok], vectors[ok]
        count[ok] += 1
    # Spare places go to the nearest that were skipped.
    for r in range(found.shape[1]):
        c = found[:, r]
        ok = np.flatnonzero((c >= 0) & (count < m) & ~(taken == c[:, None]).any(axis=1))
        taken[ok, count[ok]] = c[ok]
        count[ok] += 1
    return taken


class Graph:
    """Layers over unit vectors: members of each layer and their links, by number in the layer."""

    def __init__(self, space: np.ndarray, seed: int = 7):
        n = len(space)
        level = np.minimum((np.random.default_rng(seed).exponential(1 / np.log(LINKS), n)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        self.space, self.order = np.ascontiguousarray(space[order]), order
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers: list[np.ndarray] = []
        for k in reversed(range(len(self.sizes))):
            self.layers.insert(0, self._layer(self.sizes[k], LINKS if k else 2 * LINKS))

    def _layer(self, n: int, most: int) -> np.ndarray:
        """Links of the first ``n`` vectors, inserted in batches that at most double the graph."""
        space = self.space[:n]
        links = np.full((n, most), -1, np.int64)
        weight = np.full((n, most), -np.inf, np.float32)
        at = 0
        while at < n:
            size = min(n - at, max(32, min(at, 512)))
            new = np.arange(at, at + size)
            inside = space[new] @ space[new].T
            np.fill_diagonal(inside, -np.inf)
            near = np.argsort(-inside, axis=1, kind="stable")[:, : min(most, size - 1)]
            found, value = new[near], np.take_along_axis(inside, near, 1)
            if at:
                entry = np.minimum(self._descend(space[new], self.layers, at), at - 1)
                more, sims = beam_search(space[:at], links[:at], space[new], entry, min(BUILD_BEAM, at))
                found, value = np.concatenate([found, more], 1), np.concatenate([value, np.where(more < 0, -np.inf, sims)], 1)
                top = np.argsort(-value, axis=1, kind="stable")[:, :BUILD_BEAM]
                found, value = np.take_along_axis(found, top, 1), np.take_along_axis(value, top, 1)
            if found.shape[1]:
                chosen = _diverse(space, new, found, value, max(1, most // 2))
                self._connect(space, links, weight, new, chosen)
            at += size
        return np.where(links < 0, n, links)

    @staticmethod
    def _connect(space: np.ndarray, links: np.ndarray, weight: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Add links both ways; a full list keeps its nearest."""
        i, j = np.nonzero(chosen >= 0)
        a, b = new[i], chosen[i, j]
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        sims = np.tile(np.einsum("kd,kd->k", space[a], space[b]), 2)
        touched = np.unique(source)
        owner = np.searchsorted(touched, source)
        old = links[touched]
        keep = old >= 0
        owner = np.concatenate([np.repeat(np.arange(len(touched)), keep.sum(1)), owner])
        target, sims = np.concatenate([old[keep], target]), np.concatenate([weight[touched][keep], sims])
        _, first = np.unique(owner * (len(space) + 1) + target, return_index=True)
        owner, target, sims = owner[first], target[first], sims[first]
        order = np.lexsort((-sims, owner))
        owner, target, sims = owner[order], target[order], sims[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        ok = rank < links.shape[1]
        links[touched], weight[touched] = -1, -np.inf
        links[touched[owner[ok]], rank[ok]], weight[touched[owner[ok]], rank[ok]] = target[ok], sims[ok]

    def _descend(self, queries: np.ndarray, layers: list[np.ndarray], most: int) -> np.ndarray:
        """Entry point for the layer below ``layers`` by greedy search from the top."""
        entry = np.zeros(len(queries), np.int64)
        for links in reversed(layers):
            found, _ = beam_search(self.space[: len(links)], links, queries, entry, 2)
            entry = found[:, 0]
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the given order (-1: none) and similarities of each query's beam."""
        entry = self._descend(queries, self.layers[1:], len(self.space))
        found, value = beam_search(self.space, self.layers[0], queries, entry, min(beam, len(self.space)))
        return np.where(found >= 0, self.order[np.maximum(found, 0)], -1), value

    def audited_beam(self, threshold: float, seed: int = 3) -> int:
        """Beam at which made neighbours at the threshold lead back to their vectors."""
        rng = np.random.default_rng(seed)
        at = rng.choice(len(self.space), min(AUDITS, len(self.space)), replace=False)
        base = self.space[at]
        noise = rng.standard_normal(base.shape).astype(np.float32)
        noise -= np.einsum("qd,qd->q", noise, base)[:, None] * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        made, beam = threshold * base + np.sqrt(1 - threshold**2) * noise, BEAM
        while beam < len(self.space):
            found, value = self.search(made, beam)
            # The vector itself, or a beam that is full of others as near.
            back = (found == self.order[at][:, None]).any(axis=1) | (value[:, -1] >= threshold - 1e-3)
            if back.mean() >= RECALL:
                break
            beam *= 2
        return beam

    def to_columns(self) -> dict[str, bytes | list[int]]:
        return {"space": self.space.tobytes(), "order": self.order.astype(np.int64).tobytes(), "sizes": self.sizes, "links": b"".join(x.astype(np.int32).tobytes() for x in self.layers)}

    @classmethod
    def from_columns(cls, space: memoryview, order: memoryview, sizes: list[int], links: memoryview, d: int) -> Graph:
        g = cls.__new__(cls)
        g.space, g.order, g.sizes = np.frombuffer(space, np.float32).reshape(-1, d), np.frombuffer(order, np.int64), sizes
        flat, g.layers, at = np.frombuffer(links, np.int32), [], 0
        for k, n in enumerate(sizes):
            most = LINKS if k else 2 * LINKS
            g.layers.append(flat[at : at + n * most].reshape(n, most).astype(np.int64))
            at += n * most
        return g


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)


def _built(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        rows = matrix(table["vector"].combine_chunks())
        graph = Graph(_unit(rows))
        c = graph.to_columns()
        return pa.table({
            "shard": table["shard"].slice(0, 1), "ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()]), "copies": pa.array([table["copies"].to_numpy().astype(np.int64).tobytes()]),
            "vectors": pa.array([rows.tobytes()]), "n": pa.array([len(rows)], pa.int32()), "d": pa.array([rows.shape[1]], pa.int32()), "space": pa.array([c["space"]]), "order": pa.array([c["order"]]),
            "sizes": pa.array([c["sizes"]], pa.list_(pa.int64())), "links": pa.array([c["links"]]), "beam": pa.array([graph.audited_beam(threshold)], pa.int32()),
        })

    return run


_SHARD = ["ids", "copies", "vectors", "n", "d", "space", "order", "sizes", "links", "beam"]
_INDEX = "shard int, ids binary, copies binary, vectors binary, n int, d int, space binary, order binary, sizes array<long>, links binary, beam int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) rows to blocks of at most QUERY_ROWS."""
    for batch in batches:
        rows = matrix(batch.column(1))
        for lo in range(0, len(rows), QUERY_ROWS):
            part = rows[lo : lo + QUERY_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).slice(lo, len(part)).to_numpy().astype(np.int64).tobytes()]), pa.array([part.tobytes()]), pa.array([len(part)], pa.int32()), pa.array([part.shape[1]], pa.int32())], names=["ids", "vectors", "n", "d"])


def links_to(graph: Graph, ids: np.ndarray, rows: np.ndarray, beam: int, q_ids: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Query number and row number of every link found, confirmed in double precision."""
    units, out = _unit(queries), []
    waiting = np.arange(len(queries))
    while len(waiting):
        again = []
        step = max(1, (1 << 24) // (len(rows) + 1))
        for lo in range(0, len(waiting), step):
            part = waiting[lo : lo + step]
            found, value = graph.search(units[part], beam)
            full = (value[:, -1] >= threshold - 1e-3) & (beam < len(rows))
            again.append(part[full])
            i, j = np.nonzero((value >= threshold - 1e-3) & (found >= 0) & ~full[:, None])
            out.append((part[i], found[i, j]))
        waiting, beam = np.concatenate(again), beam * 4
    i, j = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    other = q_ids[i] != ids[j]
    i, j = i[other], j[other]
    cosine = np.einsum("kd,kd->k", queries[i], rows[j]) / (np.linalg.norm(queries[i], axis=1) * np.linalg.norm(rows[j], axis=1))
    ok = cosine >= threshold
    return i[ok], j[ok]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the given links join, at most one for each end."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


class _Opened:
    """A shard's graph and vectors, decoded once for all blocks of queries that follow it."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.ids, self.rows = unpack(row["ids"], row["vectors"], row["n"].as_py(), row["d"].as_py())
        self.copies, self.beam = np.frombuffer(row["copies"].as_buffer(), np.int64), row["beam"].as_py()
        self.graph = Graph.from_columns(row["space"].as_buffer(), row["order"].as_buffer(), row["sizes"].as_py(), row["links"].as_buffer(), row["d"].as_py())

    def links(self, q_ids: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        d = queries.shape[1]
        if d > self.rows.shape[1]:
            self.rows, self.graph.space = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (self.rows, self.graph.space))
        queries = np.pad(queries, ((0, 0), (0, self.rows.shape[1] - d)))
        return links_to(self.graph, self.ids, self.rows, self.beam, q_ids, queries, threshold)


def _linked(threshold: float):
    """Rows in order, each shard's graph before its blocks of queries, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            ends: list[list] = [[], [], []]
            for r in range(batch.num_rows):
                v = {name: batch.column(k)[r] for k, name in enumerate(batch.schema.names)}
                if v["ids"].is_valid:
                    shard = _Opened(v)
                    continue
                q_ids, queries = unpack(v["q_ids"], v["q_vectors"], v["q_n"].as_py(), v["q_d"].as_py())
                i, j = shard.links(q_ids, queries, threshold)
                count = np.bincount(i, shard.copies[j], len(q_ids)).astype(np.int64)
                some = np.flatnonzero(count)
                joins = _forest(q_ids[i], shard.ids[j])
                ends[0] += q_ids[some].tolist() + [x for x, _ in joins]
                ends[1] += [None] * len(some) + [y for _, y in joins]
                ends[2] += count[some].tolist() + [0] * len(joins)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b", "n"])

    return run


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``rows``: its id as ``vec_id``, n_links, component_id, kept.

    Equal vectors are one class and link with each other; a class is searched
    once.  ``n_links`` counts the other vectors whose cosine with this one is at
    least ``threshold`` and that its own searches found.  Null and zero vectors
    and those with a null or non-finite component link with nothing, nor do rows
    without an id (which get no component and aren't kept).  A shorter vector
    counts as ending with zeros.  Rows that share an id are one node, whatever
    their vectors.  An empty table gives an empty result.
    """
    bound_batches(rows.sparkSession, rows=2000)
    good = usable(rows, id_col, vector_col).filter(F.exists("vector", lambda x: x != 0))
    good = cut(good.withColumn("key", F.to_json(F.transform("vector", lambda x: x + F.lit(0.0)))).withColumn("key", F.sha2("key", 256)), "usable")
    classes = cut(good.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "classes")
    shards = max(MIN_SHARDS, -(-classes.count() // SHARD_ROWS))
    dealt = classes.select(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.col("rep").alias("id"), "copies", "vector")
    # By range, so that no two shards meet in a task.
    index = cut(dealt.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(_built(threshold), _INDEX), "index")
    blocks = cut(classes.select("rep", "vector").mapInArrow(_blocks, "ids binary, vectors binary, n int, d int").withColumn("no", F.monotonically_increasing_id()), "queries")
    n_blocks = blocks.count()
    tasks = max(1, min(TASKS, n_blocks), -(-n_blocks // TASK_BLOCKS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "n", "d")], F.pmod(F.xxhash64("no"), F.lit(tasks)).cast("int").alias("task"), every(shards).alias("shard"))
    opened = index.select("shard", *_SHARD, every(tasks).alias("task"))
    # Each task gets its shard's graph once and the blocks of queries behind it.
    met = opened.unionByName(asked, allowMissingColumns=True).withColumn("slot", F.col("shard") * tasks + F.col("task"))
    met = met.repartitionByRange(shards * tasks, "slot").sortWithinPartitions("slot", F.col("ids").isNull()).drop("shard", "task", "slot")
    found = cut(met.mapInArrow(_linked(threshold), "a long, b long, n long"), "links")
    labels = cut(connected_components(found.filter("b is not null").select("a", "b")), "labels")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    per = classes.select("key", "rep", "copies").join(counts, classes.rep == counts.a, "left").join(labels, F.col("rep") == labels.node, "left")
    per = per.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    own = good.select("id", "key").join(per, "key").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    none = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    idle = ~F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    alone = none.filter(idle).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``embeddings``, whatever their labels."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def with_near_copies(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding): all rows and, of every fourth, two longer copies that are turned a little."""
    turned = lambda k: F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (1 + k) + (F.pmod(i * 7 + k, F.lit(5)) - 2) * 0.01)
    whole = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = rows.filter("vec_id % 4 = 0")
    return whole.unionByName(chosen.select((-F.col("vec_id") * 2 - 1).alias("vec_id"), turned(1).alias("embedding"))).unionByName(chosen.select((-F.col("vec_id") * 2 - 2).alias("vec_id"), turned(2).alias("embedding")))


def near_vectors_planted(spark, sf_dir: str) -> DataFrame:
    """The same over ``embeddings`` with near copies of every fourth, as the table itself may hold no links."""
    return near_duplicate_vectors(with_near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


#: The definition itself, by brute force.
_SQL = """
v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM SOURCE
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
), c AS (
  SELECT node, min(reach) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
OP10_SQL = f"WITH RECURSIVE {_SQL.replace('SOURCE', 'embeddings')}"
_TURNED = "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + {0}) + (((i - 1) * 7 + {0}) % 5 - 2) * 0.01)"
PLANTED_SQL = f"""WITH RECURSIVE planted AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings UNION ALL
  SELECT -vec_id * 2 - 1, {_TURNED.format(1)} FROM embeddings WHERE vec_id % 4 = 0 UNION ALL
  SELECT -vec_id * 2 - 2, {_TURNED.format(2)} FROM embeddings WHERE vec_id % 4 = 0
), {_SQL.replace("SOURCE", "planted")}"""
