"""Sentence graphs and their communities (constant Potts model, Leiden refinement)."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np

#: Resolution, neighbours kept, quantile and least of similarities, weight and reach of position, windows, share of trigrams.
RESOLUTION, TOP, QUANTILE, FLOOR, ALPHA, SPAN, WINDOW, OVERLAP, DICE_SHARE, ROUNDS = 0.175, 10, 0.8, 0.05, 0.6, 3, 400, 40, 0.35, 20


def similarities(texts: list[str]) -> np.ndarray:
    """Lexical similarity of sentences: tf-idf cosine mixed with the Dice coefficient of trigrams."""
    bags = [Counter(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    df = Counter(w for b in bags for w in b)
    column = {w: i for i, w in enumerate(df)}
    m = np.zeros((len(texts), max(1, len(column))))
    for i, b in enumerate(bags):
        for w, n in b.items():
            m[i, column[w]] = (1 + math.log(n)) * math.log(1 + len(texts) / (1 + df[w]))
    m /= np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]
    grams = [{x[i : i + 3] for i in range(max(1, len(x) - 2))} for x in (" ".join(t.lower().split()) for t in texts)]
    every = {g: i for i, g in enumerate(set().union(*grams))}
    g = np.zeros((len(texts), max(1, len(every))))
    for i, s in enumerate(grams):
        g[i, [every[x] for x in s]] = 1
    size = g.sum(axis=1)
    dice = 2 * (g @ g.T) / np.maximum(size[:, None] + size[None, :], 1)
    return (1 - DICE_SHARE) * (m @ m.T) + DICE_SHARE * dice


def sentence_graph(sim: np.ndarray) -> dict[tuple[int, int], float]:
    """Edges between sentences that are among each other's nearest, and between neighbours in the text."""
    n = len(sim)
    edges: dict[tuple[int, int], float] = defaultdict(float)
    if n < 2:
        return edges
    values = np.sort(sim[np.triu_indices(n, 1)])
    least = max(values[min(len(values) - 1, int(len(values) * QUANTILE))], FLOOR)
    near = []
    for i in range(n):
        # Few are that near: only they are sorted, equal ones by place.
        far = np.flatnonzero((sim[i] >= least) & (np.arange(n) != i))
        near.append(set(far[np.argsort(-sim[i, far], kind="stable")[:TOP]].tolist()))
    for i in range(n):
        for j in near[i]:
            if i < j and i in near[j]:
                edges[i, j] += float(sim[i, j])
        for d in range(1, min(SPAN, n - 1 - i) + 1):
            edges[i, i + d] += ALPHA / (1 + d)
    return edges


def _neighbours(edges: dict[tuple[int, int], float]) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = defaultdict(dict)
    for (a, b), w in edges.items():
        if a != b:
            out[a][b] = out[a].get(b, 0.0) + w
            out[b][a] = out[b].get(a, 0.0) + w
    return out


def _local_moves(nodes: list[int], size: dict[int, float], near: dict, part: dict[int, int], gamma: float, rng: random.Random, within: dict[int, int] | None = None) -> None:
    """Nodes go where they gain most until none does; with ``within``, lone nodes only and inside their group."""
    weight: dict[int, float] = defaultdict(float)
    count: Counter = Counter()
    for v in nodes:
        weight[part[v]] += size[v]
        count[part[v]] += 1
    queue = list(nodes)
    rng.shuffle(queue)
    waiting = set(queue)
    while queue:
        v = queue.pop(0)
        waiting.discard(v)
        own = part[v]
        if within is not None and count[own] > 1:
            continue
        pull: dict[int, float] = defaultdict(float)
        for u, w in near.get(v, {}).items():
            if within is None or within[u] == within[v]:
                pull[part[u]] += w
        stay = pull.get(own, 0.0) - gamma * size[v] * (weight[own] - size[v])
        best, gain = own, 1e-12
        for c in sorted(pull):
            g = pull[c] - gamma * size[v] * weight[c] - stay
            if c != own and g > gain:
                best, gain = c, g
        if best != own:
            weight[own] -= size[v]
            weight[best] += size[v]
            count[own] -= 1
            count[best] += 1
            part[v] = best
            if within is None:
                for u in near.get(v, {}):
                    if part[u] != best and u not in waiting:
                        waiting.add(u)
                        queue.append(u)


def leiden(n: int, edges: dict[tuple[int, int], float], gamma: float = RESOLUTION, seed: int = 0) -> list[int]:
    """Community of each node, numbered by first appearance; the same for the same input and seed."""
    rng = random.Random(seed)
    member = list(range(n))
    nodes, size, level = list(range(n)), dict.fromkeys(range(n), 1.0), dict(edges)
    for _ in range(ROUNDS):
        near = _neighbours(level)
        part = {v: v for v in nodes}
        _local_moves(nodes, size, near, part, gamma, rng)
        refined = {v: v for v in nodes}
        _local_moves(nodes, size, near, refined, gamma, rng, within=part)
        member = [refined[m] for m in member]
        groups = sorted(set(refined.values()))
        if len(groups) == len(nodes):
            break
        grown: dict[int, float] = defaultdict(float)
        for v in nodes:
            grown[refined[v]] += size[v]
        merged: dict[tuple[int, int], float] = defaultdict(float)
        for (a, b), w in level.items():
            x, y = sorted((refined[a], refined[b]))
            if x != y:
                merged[x, y] += w
        nodes, size, level = groups, grown, merged
    first: dict[int, int] = {}
    return [first.setdefault(m, len(first)) for m in member]


def quality(edges: dict[tuple[int, int], float], part: list[int], gamma: float = RESOLUTION) -> float:
    """Constant Potts quality: weight inside communities less gamma times their pairs."""
    inside = sum(w for (a, b), w in edges.items() if a != b and part[a] == part[b])
    return inside - gamma * sum(k * (k - 1) / 2 for k in Counter(part).values())


def connected(edges: dict[tuple[int, int], float], part: list[int]) -> bool:
    """Whether every community hangs together by edges between its own members."""
    root = list(range(len(part)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        if part[a] == part[b]:
            root[find(a)] = find(b)
    return len({find(v) for v in range(len(part))}) == len(set(part))


def semantic(embed: Callable[[list[str]], np.ndarray]) -> Callable[[list[str]], np.ndarray]:
    """Similarity of sentences by the cosine of their vectors; opposite ones count as 0."""

    def similarity(texts: list[str]) -> np.ndarray:
        v = np.asarray(embed(texts), float).reshape(len(texts), -1)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        return np.maximum(v @ v.T, 0)

    return similarity


def runs(texts: list[str], seed: int, similarity: Callable[[list[str]], np.ndarray] = similarities) -> list[tuple[int, int]]:
    """Runs of neighbouring sentences of one community; long texts by overlapping windows, each sentence in one run."""
    out, covered = [], 0
    for at in range(0, len(texts), WINDOW - OVERLAP):
        window = texts[at : at + WINDOW]
        part = leiden(len(window), sentence_graph(similarity(window)), seed=seed + at)
        begin = 0
        for i in range(1, len(part) + 1):
            if i == len(part) or part[i] != part[begin]:
                a, b = max(at + begin, covered), at + i
                if a < b:
                    out.append((a, b))
                    covered = b
                begin = i
        if at + WINDOW >= len(texts):
            break
    return out
