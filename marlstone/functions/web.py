"""What a web page says: visible text, article, embedded state, tables."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

#: Elements without text of their own, boilerplate, void elements, keys of state that hold no prose.
SKIPPED = {"script", "style", "noscript", "head"}
BOILERPLATE = SKIPPED | {"nav", "aside", "footer", "header", "form", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISY = {
    "buildId", "locale", "locales", "defaultLocale", "isPreview", "isFallback", "gssp", "gip", "appGip", "runtimeConfig", "nextExport",
    "autoExport", "assetPrefix", "scriptLoader", "err", "dynamicIds", "customServer", "query", "page", "pathname", "asPath", "__N_SSP",
    "__N_SSG",
}
LD_KEYS = ("headline", "name", "description", "articleBody", "text")
_AD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo|banner|cookie\w*)(?:$|[\s_-])", re.I)
_STATE = re.compile(r"window\.(?:__INITIAL_STATE__|__PRELOADED_STATE__|__data|__NUXT__)\s*=\s*[^{]*", re.I)
_BREAKS = {"p", "div", "br", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "table"}


class _Tree(HTMLParser):
    """Elements as [name, attributes, children]; text as strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def tree(page: str) -> list:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def walk(node: list, skip: set[str] = frozenset()):
    """Elements below a node in document order."""
    todo = [c for c in reversed(node[2]) if not isinstance(c, str)]
    while todo:
        n = todo.pop()
        if n[0] not in skip:
            yield n
            todo += [c for c in reversed(n[2]) if not isinstance(c, str)]


def inner_text(node: list) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += reversed(n[2])
    return "".join(out)


def visible_text(page: str) -> str:
    """Text nodes that show, trimmed, one a line."""
    out, todo = [], [tree(page)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                out.append(n.strip())
        elif n[0] not in SKIPPED:
            todo += reversed(n[2])
    return "\n".join(out)


def _useful(node: list) -> bool:
    return node[0] not in BOILERPLATE and not _AD.search(f"{node[1].get('class', '')} {node[1].get('id', '')}")


def _markdown(node: list) -> str:
    parts = []
    for c in node[2]:
        if isinstance(c, str):
            parts.append(re.sub(r"\s+", " ", c))
        elif _useful(c):
            body, name = _markdown(c), c[0]
            if name in ("strong", "b"):
                body = f"**{body.strip()}**"
            elif name in ("em", "i"):
                body = f"*{body.strip()}*"
            elif name == "a" and c[1].get("href"):
                body = f"[{body.strip()}]({c[1]['href']})"
            elif name == "table":
                body = table_markdown([[inner_text(x).strip() for x in row[2] if not isinstance(x, str) and x[0] in ("td", "th")] for row in walk(c) if row[0] == "tr"])
            elif re.fullmatch("h[1-6]", name):
                body = f"{'#' * int(name[1])} {body.strip()}"
            elif name == "li":
                body = f"- {body.strip()}"
            parts.append(f"\n\n{body}\n\n" if name in _BREAKS - {"li", "br"} else f"\n{body}\n" if name in _BREAKS else body)
    return "".join(parts)


def article(page: str) -> str:
    """The article as Markdown: ``article`` or ``main``, else the block with the most paragraph text."""
    root = tree(page)
    nodes = list(walk(root, BOILERPLATE))
    main = next((n for name in ("article", "main") for n in nodes if n[0] == name), None)
    if main is None:
        weigh = lambda n: sum(len(inner_text(c)) for c in n[2] if not isinstance(c, str) and c[0] == "p")
        main = max([n for n in nodes if _useful(n)], key=weigh, default=root)
        main = main if weigh(main) else root
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", _markdown(main))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def scripts(page: str) -> dict[str, list[str]]:
    """Script texts: inline, linked data, and the state of pages that carry theirs."""
    out: dict[str, list[str]] = {"inline": [], "ld": [], "next": []}
    for n in walk(tree(page)):
        if n[0] == "script":
            kind = "next" if n[1].get("id") == "__NEXT_DATA__" else "ld" if n[1].get("type", "").lower() == "application/ld+json" else "" if n[1].get("src") else "inline"
            if kind and inner_text(n).strip():
                out[kind].append(inner_text(n))
    return out


def is_prose(s: str) -> bool:
    """Readable text rather than an address, code, a blob or a hash."""
    size = len(s.encode())
    return size >= 80 and not s.startswith(("http://", "https://", "/", "{", "[", "<")) and "data:" not in s and "base64," not in s and not (size < 300 and " " not in s)


def prose_of(value: object, depth: int = 0) -> list[str]:
    """Prose strings of a JSON value in document order, not too deep and not too many of a list."""
    if depth > 6:
        return []
    if isinstance(value, str):
        return [value.strip()] if is_prose(value) else []
    children = [v for k, v in value.items() if k not in NOISY] if isinstance(value, dict) else value[:20] if isinstance(value, list) else []
    return [s for c in children for s in prose_of(c, depth + 1)]


def _documents(text: str) -> list:
    """JSON values one after the other; ends at the first that can't be read."""
    out, at, read = [], 0, json.JSONDecoder()
    while at < len(text):
        at += len(text[at:]) - len(text[at:].lstrip())
        try:
            value, at = read.raw_decode(text, at)
        except ValueError:
            break
        out.append(value)
    return out


def state_text(page: str) -> str:
    """Prose of the state that scripts carry: page props, linked data, window state."""
    s, out = scripts(page), []
    for text in s["next"]:
        for doc in _documents(text):
            props = doc.get("props", {}) if isinstance(doc, dict) else {}
            out += prose_of(props.get("pageProps") if isinstance(props, dict) else None)
    for text in s["ld"]:
        for doc in _documents(text):
            for item in doc if isinstance(doc, list) else [doc]:
                hit = next((item[k] for k in LD_KEYS if isinstance(item.get(k), str) and len(item[k].encode()) > 30), None) if isinstance(item, dict) else None
                out += [hit] if hit else []
    for text in s["inline"]:
        for m in _STATE.finditer(text):
            found = [x for doc in _documents(text[m.end() :])[:1] for x in prose_of(doc)]
            if found:
                out += found
                break
    return "\n\n".join(out)


def data_table(page: str, base: str) -> dict[str, str] | None:
    """Selector and address of a table that a script fills, if it says so."""
    for text in scripts(page)["inline"]:
        for m in re.finditer(r"DataTable\s*\(\s*['\"]([^'\"]+)['\"]", text, re.I):
            near = text[m.end() : m.end() + 2000]
            address = re.search(r"\bajax\s*:\s*['\"]([^'\"#][^'\"]{0,500})['\"]", near, re.I) or re.search(r"\burl\s*:\s*['\"]([^'\"#][^'\"]{0,500})['\"]", near, re.I)
            full = urljoin(base, address[1].strip()) if address else ""
            if full.startswith(("http://", "https://")):
                return {"selector": m[1], "url": full}
    return None


def _table(page: str, selector: str) -> list | None:
    """The first table whose id or class a selector names."""
    name = selector.lstrip("#.")
    return next((n for n in walk(tree(page)) if n[0] == "table" and name and (n[1].get("id") == name or name in n[1].get("class", "").split())), None)


def table_is_filled(page: str, selector: str) -> bool:
    """Whether the table has rows in its body already."""
    found = _table(page, selector)
    return found is not None and any(r[0] == "tr" for b in walk(found) if b[0] == "tbody" for r in walk(b))


def table_header(page: str, selector: str) -> list[str]:
    """Texts of the header cells in the table's heads; empty ones are left out."""
    found = _table(page, selector)
    cells = [] if found is None else [c for h in walk(found) if h[0] == "thead" for c in walk(h) if c[0] == "th"]
    return [x for x in (inner_text(c).strip() for c in cells) if x]


def table_names(response: str) -> list[str]:
    """Names of the columns of a table response: the keys of its first row, if that is an object."""
    first = next(iter(_records(json.loads(response))), None)
    return list(first) if isinstance(first, dict) else []


def _records(value: object) -> list:
    if isinstance(value, dict):
        value = next((value[k] for k in ("data", "aaData", "rows") if isinstance(value.get(k), list)), [])
    return value if isinstance(value, list) else []


def table_rows(response: str, most: int = 200) -> list[list[str]]:
    """Rows of a table response: lists, or objects in the order of the first one's keys; tags are dropped."""
    rows, names = _records(json.loads(response)), table_names(response)
    cell = lambda x: html.unescape(re.sub(r"<[^>]*>", "", "" if x is None else str(x))).strip()
    return [[cell(x) for x in ([r.get(n) for n in names or r] if isinstance(r, dict) else r if isinstance(r, list) else [r])] for r in rows[:most]]


def fetched_table(page: str, base: str, fetch: Callable[[str], str | None]) -> str:
    """The table that a script would fill, as Markdown; empty if there is none, it is filled, or ``fetch`` of its address gives no JSON rows."""
    asked = data_table(page, base)
    if asked is None or table_is_filled(page, asked["selector"]):
        return ""
    response = fetch(asked["url"])
    try:
        rows, names = table_rows(response or ""), table_names(response or "")
    except ValueError:
        return ""
    head = table_header(page, asked["selector"]) or names
    return table_markdown([head, *rows] if head else rows) if rows else ""


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, the first as its head; short rows are padded, pipes escaped."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def links_by_class(page: str, link_class: str, text_class: str) -> list[dict[str, str]]:
    """Search results: links of a class with the next text of another class."""
    out: list[dict[str, str]] = []
    for n in walk(tree(page)):
        names = n[1].get("class", "").split()
        if link_class in names and n[1].get("href"):
            out.append({"title": inner_text(n).strip(), "url": n[1]["href"], "snippet": ""})
        elif text_class in names and out and not out[-1]["snippet"]:
            out[-1]["snippet"] = inner_text(n).strip()
    return out
