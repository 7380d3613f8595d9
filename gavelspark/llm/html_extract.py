"""Main-text extraction with a tree-structured graphical model.

A page's block elements form a tree of binary variables (content or not). Node potentials come from sparse features
(tag, words in class, id and role, the nearest container above, own text and that right below, links, place, a page
without containers); parent-child potentials depend on both labels and the
child's kind. Sum-product messages go up the tree and back down and give each node's content marginal; the text blocks
of nodes at one half or more make the result. The weights maximise the likelihood of labelled pages, by gradient steps
on the difference between observed and expected features, which the same messages yield. Training pages come from a
seeded generator (``PAGES`` of them), so that the model is the same in every process.

Edge cases: null, empty and text-free pages give an empty text; text outside any element belongs to the root, and a
page without markup is its own text; broken and unclosed markup is read as far as it goes; scripts, styles, titles,
comments and form controls never give text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import dom
from .common import per_batch, small_batches
from .sample_pages import labelled_pages

PAGES, SEED, EPOCHS = 600, 11, 14
JOIN = "\n\n"
_GROUPS = {
    "text": "p blockquote pre figcaption dd".split(),
    "heading": "h1 h2 h3 h4 h5 h6 dt".split(),
    "list": "ul ol li dl menu".split(),
    "box": "div section figure center".split(),
    "article": ["article"],
    "main": ["main"],
    "nav": ["nav"],
    "header": ["header"],
    "footer": ["footer", "address"],
    "aside": ["aside"],
    "form": "form fieldset button input legend dialog".split(),
    "table": "table tbody thead tfoot tr td th caption".split(),
    "page": "#root html body head".split(),
}
GROUP = {tag: name for name, tags in _GROUPS.items() for tag in tags}
HINTS = {
    "content": "content post entry article story main text prose".split(),
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs toolbar pagination pager toc".split(),
    "header": "header masthead banner branding logo top".split(),
    "footer": "footer copyright legal bottom colophon disclaimer imprint".split(),
    "side": "sidebar side aside widget related recommended recommend more rail trending popular teaser".split(),
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promoted adsense".split(),
    "comment": "comment comments reply replies discussion disqus respond".split(),
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription paywall".split(),
    "share": "share social sharing tags meta".split(),
    "form": "search login signup contact form".split(),
    "role": "navigation contentinfo complementary dialog alertdialog".split(),
}
HINT_OF = {word: name for name, words in HINTS.items() for word in words}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KINDS = ("text", "heading", "list", "box", "other")
_NAMES: dict[str, int] = {}


def _index(name: str) -> int:
    return _NAMES.setdefault(name, len(_NAMES))


for _n in ["bias", *(f"tag:{g}" for g in [*_GROUPS, "other"]), *(f"hint:{h}" for h in HINTS), *(f"{a}:{k}" for a in ("own", "all", "near") for k in range(6)), *(f"{a}:{k}" for a in ("links", "alllinks") for k in range(4)), "stop", "nostop", "first", "last", "classless", *(f"under:{u}{k}" for u in ("none", "content", "boiler", "both") for k in ("", ":plain", ":links")), *(f"bare:{g}" for g in ("page", "text", "heading", "box"))]:
    _index(_n)
SIZE = len(_NAMES)
#: A page without any node of these features is bare.
_CONTAINERS = frozenset(_NAMES[n] for n in ("tag:article", "tag:main", "hint:content"))
#: What makes an element one of boilerplate to those below; a header inside a container may hold its title.
_AROUND = frozenset(_NAMES[n] for n in ("tag:nav", "tag:footer", "tag:aside", "tag:form", *(f"hint:{h}" for h in HINTS if h not in ("content", "header", "share"))))
_HEADERS = frozenset(_NAMES[n] for n in ("tag:header", "hint:header"))


@lru_cache(maxsize=65536)
def _markup(tag: str, attrs: str) -> tuple[int, ...]:
    """Features of a start tag."""
    out = [_NAMES["bias"], _NAMES["tag:" + GROUP.get(tag, "other")]]
    known = dom.attributes(attrs) if attrs else {}
    words = {w.lower() for a in ("class", "id", "role", "aria-label") for w in _WORD.findall(known.get(a, ""))}
    hints = {HINT_OF[w] for w in words if w in HINT_OF}
    out += [_NAMES["hint:" + h] for h in hints]
    if not hints:
        out.append(_NAMES["classless"])
    return tuple(out)


def _step(value: int) -> int:
    return 0 if value == 0 else 1 if value < 15 else 2 if value < 50 else 3 if value < 120 else 4 if value < 300 else 5


def _share(part: int, whole: int) -> int:
    return 0 if not part else 1 if part * 3 < whole else 2 if part * 3 < 2 * whole else 3


def _containers_above(nodes: list[dom.Node], markup: list[tuple[int, ...]]) -> list[str]:
    """For each node what its ancestors are: a container of content, of boilerplate, both (content inside of
    boilerplate) or none; boilerplate inside of content is boilerplate."""
    below, out = ["none"] * len(nodes), ["none"] * len(nodes)
    for i, n in enumerate(nodes):
        state = out[i] = below[n.parent] if i else "none"
        if not _AROUND.isdisjoint(markup[i]) or state == "none" and not _HEADERS.isdisjoint(markup[i]):
            state = "boiler"
        elif not _CONTAINERS.isdisjoint(markup[i]):
            state = "both" if state in ("boiler", "both") else "content"
        below[i] = state
    return out


def features(page: dom.Page) -> list[list[int]]:
    nodes = page.nodes
    total, linked = [n.own for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
        linked[nodes[i].parent] += linked[i]
    near = [n.own for n in nodes]  # own text and that of paragraphs and headings right below
    for n in nodes[1:]:
        if GROUP.get(n.tag) in ("text", "heading"):
            near[n.parent] += n.own
    markup = [_markup(n.tag, n.attrs) for n in nodes]
    bare = not any(_CONTAINERS.intersection(f) for f in markup)
    above = _containers_above(nodes, markup)
    plain = _NAMES["classless"]
    out = []
    for i, n in enumerate(nodes):
        f = [*markup[i], _NAMES[f"near:{_step(near[i])}"], _NAMES[f"own:{_step(n.own)}"], _NAMES[f"all:{_step(total[i])}"]]
        f.append(_NAMES[f"under:{above[i]}"])
        if total[i] and linked[i] * 2 > total[i]:
            f.append(_NAMES[f"under:{above[i]}:links"])
        elif plain in markup[i]:
            f.append(_NAMES[f"under:{above[i]}:plain"])
        if n.own:
            f.append(_NAMES[f"links:{_share(n.linked, n.own)}"])
            f.append(_NAMES["stop" if n.last in ".!?:;\"'”" else "nostop"])
        if total[i]:
            f.append(_NAMES[f"alllinks:{_share(linked[i], total[i])}"])
        if bare and (name := "bare:" + GROUP.get(n.tag, "other")) in _NAMES:
            f.append(_NAMES[name])
        place = n.start / max(page.size, 1)
        if place < 0.1:
            f.append(_NAMES["first"])
        elif place > 0.9:
            f.append(_NAMES["last"])
        out.append(f)
    return out


def _kind(tag: str) -> int:
    group = GROUP.get(tag, "other")
    return KINDS.index(group) if group in KINDS else len(KINDS) - 1


@dataclass
class TreeModel:
    """Log-potentials: of features for label 1 against 0, and of (child kind, parent label, child label)."""

    node: np.ndarray
    edge: np.ndarray

    def marginals(self, page: dom.Page, feats: list[list[int]] | None = None, pairs: bool = False):
        """P(content) per node; with ``pairs`` also P(parent, child) per node but the root."""
        nodes = page.nodes
        w = self.node.tolist()
        e = np.exp(self.edge).tolist()
        feats = feats or features(page)
        odds = [math.exp(max(-30.0, min(30.0, sum(w[k] for k in f)))) for f in feats]
        kinds = [_kind(n.tag) for n in nodes]
        # up: what the subtree of a node says about the node, scaled to sum to 1
        up = [(1.0, o) for o in odds]
        message = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b0, b1 = up[i]
            t = e[kinds[i]]
            m0, m1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
            s = m0 + m1
            message[i] = (m0 / s, m1 / s)
            p = nodes[i].parent
            p0, p1 = up[p][0] * m0 / s, up[p][1] * m1 / s
            s = p0 + p1
            up[p] = (p0 / s, p1 / s)
        belief = [(0.0, 0.0)] * len(nodes)
        b0, b1 = up[0]
        belief[0] = (b0 / (b0 + b1), b1 / (b0 + b1))
        joint = []
        # down: the parent's belief without what this child said
        for i in range(1, len(nodes)):
            p = nodes[i].parent
            q0, q1 = belief[p][0] / max(message[i][0], 1e-300), belief[p][1] / max(message[i][1], 1e-300)
            t, (u0, u1) = e[kinds[i]], up[i]
            j00, j01, j10, j11 = q0 * t[0][0] * u0, q0 * t[0][1] * u1, q1 * t[1][0] * u0, q1 * t[1][1] * u1
            s = j00 + j01 + j10 + j11
            belief[i] = ((j00 + j10) / s, (j01 + j11) / s)
            if pairs:
                joint.append((j00 / s, j01 / s, j10 / s, j11 / s))
        content = [b[1] for b in belief]
        return (content, joint) if pairs else content

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        tree = dom.read(page)
        if not tree.blocks:
            return ""
        content = self.marginals(tree)
        return JOIN.join(text for at, text in tree.blocks if content[at] >= 0.5)


_GOLD = re.compile(r'data-y="([01])"')


def gold(page: dom.Page) -> list[int]:
    """Labels of a generated page; text outside any element is content there."""
    labels = [int(m[1]) if (m := _GOLD.search(n.attrs)) else 0 for n in page.nodes]
    return [int(page.nodes[0].own > 0), *labels[1:]]


def train(pages: list[str], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> TreeModel:
    """Maximum likelihood by adaptive gradient steps, one page at a time."""
    model = TreeModel(np.zeros(SIZE), np.zeros((len(KINDS), 2, 2)))
    read = [dom.read(p) for p in pages]
    data = [(t, features(t), gold(t), [_kind(n.tag) for n in t.nodes]) for t in read]
    sum_node, sum_edge = np.full(SIZE, 1e-2), np.full(model.edge.shape, 1e-2)
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            tree, feats, y, kinds = data[k]
            content, joint = model.marginals(tree, feats, pairs=True)
            g_node, g_edge = -decay * model.node, -decay * model.edge
            for f, t, c in zip(feats, y, content):
                g_node[f] += t - c
            for i in range(1, len(y)):
                g_edge[kinds[i], y[tree.nodes[i].parent], y[i]] += 1
                g_edge[kinds[i]] -= np.array(joint[i - 1]).reshape(2, 2)
            sum_node += g_node**2
            sum_edge += g_edge**2
            model.node += rate * g_node / np.sqrt(sum_node)
            model.edge += rate * g_edge / np.sqrt(sum_edge)
    return model


@lru_cache(maxsize=2)
def default_model(pages: int = PAGES, seed: int = SEED) -> TreeModel:
    return train(labelled_pages(pages, seed))


def extract_text(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None, out_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rest = [c for c in pages.columns if c not in (html_col, out_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [shared.value.extract(h) for h in batch.column(html_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, out_col])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{out_col}` string"])
    return small_batches(pages).select(*[F.col(f"`{c}`") for c in [*rest, html_col]]).mapInArrow(per_batch(run), schema)
