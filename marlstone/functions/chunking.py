"""Chunks of notes: by headings, or by communities of sentences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import community, prose
from .embedding import feature_hash
from .markdown import Block

#: Most and least tokens of a chunk, tokens of context before an embedded one and of reasoning in it.
MOST, LEAST, PREFIX, REASONING = 416, 64, 96, 48
ATOMIC = {"code", "table"}


#: What counts a text's tokens, and what gives the similarities of sentences; a caller may put others in.
Counter = Callable[[str], int]
Similarity = Callable[[list[str]], np.ndarray]


@dataclass
class Chunk:
    text: str
    heading_path: str
    community: int
    tokens: int


def _written(b: Block) -> str:
    return f"{'#' * b.level} {b.text}" if b.kind == "heading" else b.text


def fill(parts: list[str], joint: str, path: str, count: Counter, number: int = 0, lead: str = "") -> list[Chunk]:
    """Parts in order, packed into chunks while they fit; a part that never fits stays whole."""
    out: list[Chunk] = []

    def flush() -> None:
        text = (lead + joint.join(held)).strip()
        out.append(Chunk(text, path, number, count(text)))

    held, used = [], count(lead)
    for part in parts:
        n = count(part)
        if held and used + n > MOST:
            flush()
            held, used = [], count(lead)
        held.append(part)
        used += n
    if held:
        flush()
    return out


def merge_small(chunks: list[Chunk], count: Counter) -> list[Chunk]:
    """Small chunks join the one before them, within a heading and a community, if both fit."""
    out: list[Chunk] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and c.tokens < LEAST and (last.heading_path, last.community) == (c.heading_path, c.community) and last.tokens + c.tokens <= MOST:
            text = f"{last.text}\n\n{c.text}"
            out[-1] = Chunk(text, last.heading_path, last.community, count(text))
        else:
            out.append(c)
    return out


def regions(blocks: list[Block]) -> list[tuple[str, list[Block]]]:
    """Runs of blocks under one heading; the heading leads its run. Rules carry nothing."""
    out: list[tuple[str, list[Block]]] = []
    for b in blocks:
        if b.kind == "heading" or not out:
            out.append((b.heading_path, []))
        if b.kind != "rule":
            out[-1][1].append(b)
    return [(path, run) for path, run in out if any(b.kind != "heading" for b in run)]


def by_headings(blocks: list[Block], count: Counter = prose.estimate_tokens) -> list[Chunk]:
    """Blocks packed under their headings. Code and tables are never cut, long prose is, between sentences."""
    out: list[Chunk] = []
    for path, run in regions(blocks):
        held: list[Block] = []
        for b in run:
            if count(b.text) > MOST and b.kind not in ATOMIC:
                out += fill([_written(x) for x in held], "\n\n", path, count) if any(x.kind != "heading" for x in held) else []
                out += fill(prose.sentences(b.text), " ", path, count)
                held = []
            else:
                held.append(b)
        if any(x.kind != "heading" for x in held):
            out += fill([_written(x) for x in held], "\n\n", path, count)
    return merge_small([c for c in out if c.text], count)


def by_communities(blocks: list[Block], count: Counter = prose.estimate_tokens, similarity: Similarity = community.similarities) -> list[Chunk]:
    """Like ``by_headings``, but prose is cut where the communities of its sentences change."""
    out: list[Chunk] = []
    for path, run in regions(blocks):
        lead = f"{_written(run[0])}\n\n" if run[0].kind == "heading" else ""
        texts = [s for b in run if b.kind not in ATOMIC | {"heading"} for s in prose.sentences(b.text)]
        out += [Chunk(b.text, path, 0, count(b.text)) for b in run if b.kind in ATOMIC]
        if len(texts) < 4:
            out += fill(texts, " ", path, count, 0, lead)
            continue
        seed = feature_hash("\0".join(texts))
        for number, (a, b) in enumerate(community.runs(texts, seed, similarity), 1):
            out += fill(texts[a:b], " ", path, count, number, lead)
    return merge_small([c for c in out if c.text], count)


def embedded_text(path: str, thread: str, reasoning: str, body: str) -> str:
    """What is embedded: context within its budget, then the body within its own."""
    parts, left = [], PREFIX
    for text, cap in ((path, PREFIX), (thread, PREFIX), (reasoning, REASONING)):
        clipped = prose.clip_tokens(text.strip(), min(cap, left)) if text and left > 0 else ""
        if clipped:
            parts.append(clipped)
            left -= prose.estimate_tokens(clipped)
    return "\n".join([*parts, prose.clip_tokens(body.strip(), MOST)])
