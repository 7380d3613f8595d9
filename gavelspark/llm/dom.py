"""A tolerant HTML reader: block nodes of the document tree and the text blocks between block boundaries.

Tags are cut as browsers cut them: an attribute value is quoted only if it starts with a quote, so one inside a name or
an unquoted value is a character like any other, and a quote that nothing closes ends with its word. Elements whose
content is no text of the page are skipped up to their own end tag. One without an end tag ends at the next block, so
that what follows is not lost; only an unclosed script or style takes the rest of the page, as in a browser. Open
elements are kept by name as well as in order, so reading is linear however broken a page is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

_VALUE = r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)"
_ATTRIBUTES = rf"(?:[\s/]+|(?:=[^\s/>=]*|[^\s/>=]+)(?:{_VALUE})?)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
_MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mspace mtable mtr mtd semantics"
INLINE = frozenset(f"a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd mark nobr picture q ruby rp rt s samp small span strike strong sub sup time tt u var video wbr {_MATH}".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold text only, up to their end tag.
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
#: Elements whose whole content is left out.
SKIPPED = frozenset("noscript template svg select object label button legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these names (up to the nearest scope).
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot body div article section main nav aside header footer form blockquote td th".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|</{tag}\Z", re.I) for tag in RAW}
_TAG = re.compile(r"<[a-zA-Z/!]")
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|center|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?=[\s/>])", re.I)
_SVG_TEXT = re.compile(r"<(?:foreignobject|desc|title)(?=[\s/>])", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    parent: int
    start: int  # offset in the page
    own: int = 0  # characters of own text
    linked: int = 0  # of which in links
    last: str = ""
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]
    size: int


def attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}


@lru_cache(maxsize=None)
def _marks(tag: str) -> re.Pattern[str]:
    return re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)|\Z)|<(?P<end>/?)(?P<tag>{tag})(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)", re.S | re.I)


def _closings(page: str, tag: str) -> dict[int, int]:
    """End of each start tag of a skipped element -> end of the end tag that belongs to it."""
    found, open_ = {}, []
    for m in _marks(tag).finditer(page):
        if m["tag"] and not m["end"] and not m[0].endswith("/>"):
            open_.append(m.end())
        elif m["tag"] and m["end"] and open_:
            found[open_.pop()] = m.end()
    return found


def read(page: str) -> Page:
    nodes = [Node("#root", "", -1, 0)]
    blocks: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = [("#root", 0)]  # (tag, block node that holds text here)
    where: dict[str, list[int]] = {}  # places in open_ by tag
    solid: list[int] = []  # places of elements that are not inline
    scopes: list[int] = []
    unclosed: set[str] = set()  # elements that hold text only and have no end tag from here on
    run: list[str] = []
    links = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                at = open_[-1][1]
                blocks.append((at, text))
                nodes[at].own += len(text)
                nodes[at].linked += min(linked, len(text))
                nodes[at].last = text[-1]
        linked = 0

    def push(tag: str, node: int) -> None:
        nonlocal links
        where.setdefault(tag, []).append(len(open_))
        if tag not in INLINE:
            solid.append(len(open_))
        if tag in SCOPE:
            scopes.append(len(open_))
        links += tag == "a"
        open_.append((tag, node))

    def close(k: int) -> None:
        """Close the open elements from place ``k`` on."""
        nonlocal links
        if solid and solid[-1] >= k:
            flush()
        while len(open_) > k:
            tag, _ = open_.pop()
            where[tag].pop()
            links -= tag == "a"
            for places in (solid, scopes):
                if places and places[-1] == len(open_):
                    places.pop()

    def last(tags: Iterable[str]) -> int:
        """Place of the last open element of these tags, 0 if there is none."""
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            run.append(piece)
            if links:
                linked += len(piece.strip())

    def after_skipped(tag: str, at: int) -> int:
        """Where reading goes on behind a skipped element whose start tag ends at ``at``."""
        if tag not in closings:
            closings[tag] = _closings(page, tag)
        end = closings[tag].get(at)
        block = _BLOCK.search(page, at, size if end is None else end) if end is None or tag == "svg" else None
        if block and (end is None or not _SVG_TEXT.search(page, at, block.start())):
            return block.start()  # blocks break out of a drawing
        return size if end is None else end

    closings: dict[str, dict[int, int]] = {}
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = last(HEADINGS if tag in HEADINGS else (tag,))
            if k and (tag not in INLINE or not solid or k > solid[-1]):
                close(k)
            continue
        if tag in RAW:
            end = None if tag in unclosed else _RAW_END[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
            if end is not None:
                at = end.end()
            elif tag in ("script", "style"):
                at = size
            else:
                at = size if (next_tag := _TAG.search(page, at)) is None else next_tag.start()
            text(" ")
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/"):
                at = after_skipped(tag, at)
            text(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag not in VOID and not m[3].endswith("/"):
                push(tag, open_[-1][1])
            continue
        flush()
        closing = CLOSES.get(tag, {"p"})
        k = last(closing)
        if k and k >= next((s for s in reversed(scopes) if open_[s][0] not in closing), 0):
            close(k)
        if tag in VOID:
            continue
        parent = open_[-1][1]
        nodes.append(Node(tag, m[3], parent, m.start()))
        nodes[parent].children.append(len(nodes) - 1)
        push(tag, len(nodes) - 1)
    flush()
    return Page(nodes, blocks, size)
