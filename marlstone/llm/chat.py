"""Conversations from reply trees, in one template.

Replies point at their parents.  Self-joins that double the distance of every
pointer enumerate the paths from each leaf to its root in logarithmically many
rounds; they give each branch its score.  The best branches of a tree are
chosen, the same pointers collect their members, and every chosen path is
formatted as one conversation, turn by turn, so that its length isn't bounded by
memory.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  In texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|`` (and a line end in a role
``\\n``), so no control string can arise and everything can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut, release

#: The control strings of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the part of it, in code points, under the loss mask."""
    head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + (len(body) if role == LEARNED else 0)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    out = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest.removesuffix(f"{END}\n"))))
    return out


def _doubled(start: DataFrame, rounds: int) -> list[DataFrame]:
    """Tables of pointers (tree, node, up, gain, steps, least): in that of round k they span up to 2**k steps.

    ``gain`` sums what lies below ``up`` and ``least`` is the smallest node there.
    """
    jumps = [cut(start, "jumps")]
    while len(jumps) <= rounds and jumps[-1].filter("up is not null").limit(1).count():
        last = jumps[-1]
        # Pointers that have reached their root are carried along, not joined again.
        live, there = last.filter("up is not null"), last.filter("up is null")
        above = last.select("tree", F.col("node").alias("up"), *[F.col(c).alias(f"{c}_2") for c in ("up", "gain", "steps", "least")])
        joined = live.join(above, ["tree", "up"])
        further = joined.select("tree", "node", F.col("up_2").alias("up"), (F.col("gain") + F.col("gain_2")).alias("gain"), (F.col("steps") + F.col("steps_2")).alias("steps"), F.least("least", "least_2").alias("least"))
        jumps.append(cut(further.unionByName(there), "jumps"))
    return jumps


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, node, depth) of the members of each tree's best branches.

    ``nodes`` has tree (string), node and parent (long, in any order), score
    (double).  A branch is a path from a root to a leaf and its score the sum of
    its nodes'; ties go to the smaller leaf.  A node whose parent is null, missing
    or itself is a root, and so is the smallest node of a cycle; a null score
    counts as 0.  (tree, node) must be unique.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.filter("parent <> node").join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent")
    start = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("gain")).join(linked, ["tree", "node"], "left")
    start = start.select("tree", "node", F.col("parent").alias("up"), "gain", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("node").alias("least"))
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, (most - 1).bit_length())  # 2**rounds steps lead out of every tree
    jumps = _doubled(start, rounds)
    lost = jumps[-1].filter("up is not null")
    if lost.limit(1).count():
        # After so many steps a pointer has gone all round its cycle.
        ring = lost.join(lost.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_semi")
        heads = ring.filter("node = least").select("tree", "node", F.lit(True).alias("head"))
        opened = jumps[0].join(heads, ["tree", "node"], "left").withColumn("up", F.when(F.col("head").isNull(), F.col("up")))
        opened = opened.withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(F.col("steps")).cast("long")).drop("head")
        old, jumps = jumps, _doubled(opened, rounds)
        release(*old)
    parents = jumps[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = jumps[-1].join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("gain"), "node"))
    path = leaves.withColumn("branch", rank).filter(F.col("branch") <= branches).select("tree", "branch", "node", F.col("steps").alias("depth"))
    # A node's pointer of round k spans 2**k steps: from far to near, what is found
    # doubles. Each round is written, so that the plan doesn't double as well.
    for k in reversed(range(len(jumps) - 1)):
        up = jumps[k].filter("up is not null").select("tree", "node", "up")
        above = path.join(up, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        path = cut(path.unionByName(above), "path")
        release(jumps[k])
    return path


_TURNS = "tree string, branch int, conv_id long, depth long, formatted string, loss_start long, loss_end long"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to formatted turns; loss bounds count from the conversation's start."""
    now, at = None, 0
    for batch in batches:
        trees, branches, convs, depths, roles, texts = (c.to_pylist() for c in batch.columns)
        out, start, end = [], [], []
        for tree, branch, role, text in zip(trees, branches, roles, texts, strict=True):
            if (tree, branch) != now:
                now, at = (tree, branch), 0
            line, a, b = format_turn(role or "", text or "")
            out.append(line), start.append(at + a), end.append(at + b)
            at += len(line)
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(branches, pa.int32()), pa.array(convs, pa.int64()), pa.array(depths, pa.int64()), pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["tree", "branch", "conv_id", "depth", "formatted", "loss_start", "loss_end"])


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Formatted turns of the best branches of reply trees.

    ``messages`` has conv_id, node, parent (long), score (double), role, text.
    Returned in order within partitions, a conversation never in two of them:
    tree, branch, conv_id, depth, formatted, loss_start, loss_end (the text under
    the loss mask in code points of the whole conversation; empty if nothing is).
    Null roles and texts count as empty; a null conv_id is a conversation of its
    own; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(messages.sparkSession, rows=1000)
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = cut(messages.select(tree.alias("tree"), "conv_id", "node", "parent", "score", "role", "text"), "messages")
    path = best_paths(rows.select("tree", "node", "parent", "score"), branches)
    turns = rows.select("tree", "node", "conv_id", "role", "text").join(path, ["tree", "node"])
    ordered = turns.select("tree", "branch", "conv_id", "depth", "role", "text").repartition("tree", "branch").sortWithinPartitions("tree", "branch", "depth")
    return ordered.mapInArrow(_formatted, _TURNS)


class _Digest:
    """Running digests over the formatted turns of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.chars, self.loss, self.at = conv_id, 0, 0, 0, 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        for role, text in parse_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        under = unescape(formatted[start - self.at : end - self.at])
        self.loss += len(under)
        self.learned.update(under.encode())
        self.at += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.at


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, done = None, None, []

    def table() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        trees, branches, convs, _, lines, starts, ends = (c.to_pylist() for c in batch.columns)
        for tree, branch, conv, line, a, b in zip(trees, branches, convs, lines, starts, ends, strict=True):
            if (tree, branch) != now:
                if digest is not None:
                    done.append(digest.row())
                now, digest = (tree, branch), _Digest(conv)
            digest.add(line, a, b)
        if len(done) > 1000:
            yield table()
            done = []
    if digest is not None:
        done.append(digest.row())
        yield table()


#: The texts of the conversation that is added as number -1.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op3_format_chat(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` as reply chains, formatted, and what reading them back gives.

    Rows of a conversation follow each other by turn, then role and text where
    turns are equal; each replies to the one before.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PROBE).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = rows.unionByName(probe).withColumn("node", node).withColumn("parent", F.col("node") - 1).withColumn("score", F.lit(1.0))
    return format_trees(nodes).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
