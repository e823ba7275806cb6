"""Sentences and token estimates of plain text."""

from __future__ import annotations

import re

#: Words whose full stop ends no sentence.
ABBREVIATIONS = {
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "eg", "ie", "cf", "al", "fig", "no", "inc", "ltd", "co", "corp",
    "approx", "min", "max", "avg", "vol", "ch", "sec", "ref", "e.g", "i.e",
}
_STOP = re.compile(r"[.!?]+[\"')\]}”’»]*")
_LAST_WORD = re.compile(r"(?:[^\W\d_]|\.)*$")
_NEXT = re.compile(r"\s*(\S?)")
_SPAN = re.compile(r"`[^`]*(?:`|$)")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def _is_end(text: str, at: int, stop: int, marks: str) -> bool:
    """Whether the run of marks at ``at``, which ends before ``stop``, closes a sentence.

    Looks at a bounded stretch before the marks only.
    """
    if stop < len(text) and not text[stop].isspace():
        return False
    if marks == ".":
        before = text[max(0, at - 32) : at]
        if before[-1:].isalpha() and not before[-2:-1].isalpha():
            return False  # an initial
        if _LAST_WORD.search(before)[0].strip(".").lower() in ABBREVIATIONS:
            return False
    return not _NEXT.match(text, stop)[1].islower()


def sentences(text: str) -> list[str]:
    """Sentences of a text, trimmed; code spans are opaque.

    Stops, with closing quotes and brackets, end a sentence before white space or
    the end, unless they follow an initial or an abbreviation or a lower-case word
    goes on.
    """
    hidden = _SPAN.sub(lambda m: "\0" * len(m[0]), text)
    out, begin = [], 0
    for m in _STOP.finditer(hidden):
        if _is_end(hidden, m.start(), m.end(), m[0]):
            out.append(text[begin : m.end()])
            begin = m.end()
    out.append(text[begin:])
    return [s.strip() for s in out if s.strip()]


def estimate_tokens(text: str) -> int:
    """Tokens as the column expression ``token_count`` estimates them."""
    total = 0
    for piece in _TOKEN.findall(text):
        size = len(piece.encode())
        total += 1 + (size - 3) // 4 if piece[0].isalnum() and size > 6 else 1
    return total


def clip_tokens(text: str, most: int) -> str:
    """Leading words that fit into ``most`` estimated tokens."""
    taken, used = [], 0
    for word in text.split():
        used += estimate_tokens(word)
        if used > most:
            break
        taken.append(word)
    return text if len(taken) == len(text.split()) else " ".join(taken)
