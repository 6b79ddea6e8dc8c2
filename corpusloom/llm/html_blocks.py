"""Blocks of an HTML page: the leaf sequence that the labeller reads."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# fixed values: elements that begin and end a block of text
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
# fixed values: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an element that ends an open one of the same kind, and those it must not look beyond
_CLOSES = {
    "p": ({"p"}, {"article", "aside", "blockquote", "body", "div", "footer", "form", "header", "main", "nav", "section", "td"}),
    "li": ({"li"}, {"ol", "ul", "menu"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"body", "head", "html", "button", "label", "option", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "noscript", "template", "textarea", "select", "iframe"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    """Tags from the root, each followed by the words of its class, id and role as '.word'."""
    linked: int
    """Characters inside links."""


def _label(tag: str, attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return (tag,)
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower()
    return (tag, *("." + w for w in _SPLIT.split(names) if w))


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order. Scripts, styles, comments and markup are no text; character references are
    decoded; white space inside a block becomes one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    in_link = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, path, linked))
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(page or ""):
        kind = m.lastgroup
        if kind == "text":
            part = m["text"]
            if "&" in part:
                part = html.unescape(part)
            if not text:
                if part.isspace():
                    continue
                path = tuple(x for _, label in stack for x in label)
            text.append(part)
            if in_link:
                linked += len(part)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            if tag == "a" and in_link:
                in_link -= 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "br":
            text.append(" ") if text else None
            continue
        if tag in BLOCK:
            flush()
            closes, stop = _CLOSES.get(tag, ({"p"}, _CLOSES["p"][1]) if tag in _ENDS_P else (None, None))
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in stop:
                        break
            in_link = 0 if tag not in ("button", "label") else in_link
        if tag not in VOID and not m["attrs"].endswith("/"):
            if tag == "a":
                in_link += 1
            stack.append((tag, _label(tag, m["attrs"])))
            if len(stack) > 400:  # markup that never closes: keep the path bounded
                del stack[200:300]
    flush()
    return out
