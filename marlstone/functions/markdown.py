"""Markdown notes: front matter, blocks, links, tags, dates."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Fixed value: what joins the parts of a heading path.
PATH_JOIN = " › "
_FENCE = re.compile(r"^(```|~~~)")
_ATX = re.compile(r"^(#{1,6}) +(.*?)[ #]*$")
_RULE = re.compile(r"^(?=.{3})(?:-[- ]*|\*[* ]*|_[_ ]*)$")
_UNDERLINE = re.compile(r"^(?:={2,}|-{2,})$")
_ITEM = re.compile(r"^(?:[-*+] |\d+[.)] )")
_DELIMITER = re.compile(r"^(?=.*-)[|:\- ]+$")
_WIKI = re.compile(r"(!?)\[\[([^\]\[|#]+)(#[^\]\[|]+)?(\|[^\]\[]+)?\]\]")
_MD_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
_TAG = re.compile(r"(?:^|(?<=[\s(\[{,;:]))#([^\W\d_](?:[^\W_]|[-_/])*)")
@dataclass
class Block:
    """A block of a note; ``level`` is 0 but for headings."""

    kind: str
    text: str
    heading_path: str
    level: int
    start_line: int


def _is_row(line: str) -> bool:
    return line.startswith("|") or line.count("|") >= 1 and not line.startswith(">")


def blocks(text: str) -> list[Block]:
    """Headings, code, tables, lists, quotes, rules and paragraphs in order.

    Fences hold everything up to one like them or the end. A table is a row with
    a delimiter row under it and the rows that follow. Headings make the path of
    what comes after; skipped levels don't leave gaps.
    """
    lines, out, path = text.split("\n"), [], []
    held: list[str] = []
    kind, began, i = "paragraph", 0, 0

    def emit(k: str, t: str, line: int, level: int = 0) -> None:
        out.append(Block(k, t, PATH_JOIN.join(path), level, line))

    def close() -> None:
        nonlocal held, kind
        if any(x.strip() for x in held):
            emit(kind, "\n".join(held).rstrip(), began)
        held, kind = [], "paragraph"

    def heading(title: str, level: int, line: int) -> None:
        path[level - 1 :] = [title]
        emit("heading", title, line, level)

    while i < len(lines):
        line, bare = lines[i], lines[i].strip()
        below = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if fence := _FENCE.match(bare):
            close()
            stop = next((j for j in range(i + 1, len(lines)) if re.fullmatch(rf"{re.escape(fence[1])}{re.escape(fence[1][0])}*\s*", lines[j].strip())), len(lines) - 1)
            emit("code", "\n".join(lines[i : stop + 1]), i + 1)
            i = stop
        elif (atx := _ATX.match(bare)) and atx[2].strip():
            close()
            heading(atx[2].strip(), len(atx[1]), i + 1)
        elif len(held) == 1 and kind == "paragraph" and _UNDERLINE.match(bare):
            title, held = held[0].strip(), []
            heading(title, 1 if bare[0] == "=" else 2, i)
        elif not bare:
            close()
        elif _RULE.match(bare):
            close()
            emit("rule", bare, i + 1)
        elif _is_row(bare) and _DELIMITER.match(below) and "|" in below:
            close()
            stop = i + 1
            while stop + 1 < len(lines) and _is_row(lines[stop + 1].strip()):
                stop += 1
            emit("table", "\n".join(lines[i : stop + 1]), i + 1)
            i = stop
        else:
            new = "list" if _ITEM.match(bare) else "quote" if bare.startswith(">") else "paragraph"
            if held and kind == "paragraph" and new != "paragraph":
                close()
            if not held:
                kind, began = new, i + 1
            held.append(line)
        i += 1
    close()
    return out


def split_front_matter(text: str) -> tuple[str, str]:
    """The block between ``---`` and ``---`` or ``...`` at the start, and the rest."""
    m = re.match(r"\ufeff?---[ \t]*\n(.*?)(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\n|$)(.*)", text, re.S)
    return (m[1], m[2]) if m else ("", text)


def front_matter(text: str) -> dict[str, list[str]]:
    """Keys (lower case) and values of a simple YAML block: scalars, inline and block lists."""
    out: dict[str, list[str]] = {}
    key = None
    clean = lambda v: v.strip().strip("\"'")
    for line in split_front_matter(text)[0].split("\n"):
        if (item := re.match(r"\s*-\s+(.*)", line)) and key:
            out[key].append(clean(item[1]))
        elif pair := re.match(r"([\w .-]+):\s*(.*)$", line):
            key, value = pair[1].strip().lower(), pair[2].strip()
            inline = re.match(r"\[(.*)\]$", value)
            out[key] = [clean(v) for v in inline[1].split(",") if v.strip()] if inline else [clean(value)] if value else []
    return out


def strip_code(text: str) -> str:
    """The text with fenced blocks and code spans blanked, line by line."""
    out, fence = [], None
    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            fence = None if bare.startswith(fence) and not bare.strip(fence[0]).strip() else fence
            out.append("")
        elif m := _FENCE.match(bare):
            fence = m[1]
            out.append("")
        else:
            out.append(re.sub(r"`[^`]*(?:`|$)", lambda m: " " * len(m[0]), line))
    return "\n".join(out)


def links(text: str) -> list[dict]:
    """Wikilinks and links to local notes, with heading, alias, whether embedded, and as written."""
    clean, out = strip_code(text), []
    for m in _WIKI.finditer(clean):
        if m[2].strip():
            out.append({"target": m[2].strip(), "heading": (m[3] or "#")[1:].strip(), "alias": (m[4] or "|")[1:].strip(), "embed": m[1] == "!", "raw": m[0]})
    for m in _MD_LINK.finditer(clean):
        target, _, heading = m[2].partition("#")
        if "://" not in m[2] and target.lower().endswith((".md", ".markdown")):
            out.append({"target": target, "heading": heading, "alias": m[1], "embed": False, "raw": m[0]})
    return out


def tags(text: str) -> list[str]:
    """Inline tags, lower case, each once; headings and code have none."""
    found = [t.lower() for line in strip_code(text).split("\n") if not _ATX.match(line.strip()) for t in _TAG.findall(line)]
    return list(dict.fromkeys(found))
