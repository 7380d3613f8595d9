"""Labelled pages for training the extractor: a seeded generator of varied layouts.

Every block element carries ``data-y``: 1 for main content and its container, 0 for the rest. Markup is drawn from many habits of real
pages: semantic and class-only containers, also one inside another, content in sections, figures and boxes with and
without a class, text right in a box, boilerplate of the same tags in every place including inside the article,
comments, notices, forms, unclosed paragraphs and list items, pages cut off at the end. Some pages have no container: their paragraphs lie
in the body, or their text stands there (or in no element at all) with line breaks.
"""

from __future__ import annotations

import random

_SYLLABLES = "an er in th on es ra ti or ve lu mo é à ü ka no si te ol qu sh ma pe do".split()
_CONTENT = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-text", "page-content", "article__body"]
#: Names of boxes that say nothing of what they hold.
_NEUTRAL = ["row", "col-8", "inner", "block", "wrapper", "grid", "x1a2b", "section", "body-copy", "rich", "module", "container", "sc-f3", "media", "image"]
_BOILER = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "main-menu", "navigation", "topnav"],
    "header": ["header", "masthead", "site-header", "banner", "top-bar", "branding"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom"],
    "sidebar": ["sidebar", "widget", "related", "side", "recommended", "more-stories", "rail"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "ad-slot"],
    "notice": ["cookie-notice", "notice", "consent", "alert", "gdpr-banner", "popup", "newsletter", "subscribe-box"],
    "comments": ["comments", "comment-list", "replies", "discussion", "reader-comments"],
    "share": ["share", "social", "share-buttons", "tags", "byline-meta"],
    "form": ["search-form", "login", "contact-form", "signup"],
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        out = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        text = " ".join(out).capitalize()
        return text + self.r.choice([".", ".", ".", "!", "?"])

    def text(self, low: int, high: int) -> str:
        return " ".join(self.words(self.r.randint(1, 14)) for _ in range(self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            i = self.r.randrange(len(parts))
            parts[i] = self.r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(parts[i])
        return " ".join(parts)

    def named(self, names: list[str]) -> str:
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} box"', f' class="c-{name}"'])

    def link_list(self, y: int = 0) -> str:
        items = "".join(f'<li data-y="{y}"><a href="/{k}">{self.words(self.r.randint(1, 3)).rstrip(".!?")}</a></li>' for k in range(self.r.randint(2, 8)))
        return f'<ul data-y="{y}">{items}</ul>'

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.12:  # hardly any text
            return "".join(f'<p data-y="1">{self.words(r.randint(1, 6))}</p>' for _ in range(r.randint(1, 3)))
        if r.random() < 0.8:
            h = f'<h1 data-y="1">{self.words(r.randint(2, 12))}</h1>'
            out.append(f'<header data-y="1">{h}</header>' if r.random() < 0.15 else h)
        if r.random() < 0.1:  # many short lines without a full stop
            out += [f'<p data-y="1">{self.words(r.randint(1, 24))[:-1]}{end}</p>' for end in r.choices([",", "", " |"], k=r.choice([10, 30, 80, 160]))]
        out += self.parts(r.choice([0, 1, 1, 2, 3, 5, 8, 14]), depth=0)
        return "".join(out)

    def parts(self, count: int, depth: int) -> list[str]:
        """Pieces of an article, some in boxes of their own."""
        r, out = self.r, []
        while count > 0:
            if depth < 3 and r.random() < 0.3:
                inside = r.randint(1, count)
                out.append(self.boxed("".join(self.parts(inside, depth + 1))))
                count -= inside
            else:
                out.append(self.part())
                count -= 1
            if r.random() < 0.08:
                out.append(self.boiler(r.choice(["ad", "sidebar", "share", "notice", "form", "nav"])))
        return out

    def boxed(self, inner: str) -> str:
        r = self.r
        tag = r.choice(["div", "div", "section", "section", "div"])
        name = r.choice(["", "", self.named(_NEUTRAL), self.named(_CONTENT)])
        head = f'<h2 data-y="1">{self.words(r.randint(1, 6))}</h2>' if tag == "section" and r.random() < 0.7 else ""
        return f'<{tag}{name} data-y="1">{head}{inner}</{tag}>'

    def part(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.08:
            k = r.randint(2, 4)
            return f'<h{k} data-y="1">{self.words(r.randint(1, 6))}</h{k}>'
        if kind < 0.16:
            return '<ul data-y="1">' + "".join(f'<li data-y="1">{self.inline(self.text(1, 2))}' + r.choice(["</li>", ""]) for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.2:
            return f'<blockquote data-y="1">{self.inline(self.text(1, 3))}</blockquote>'
        if kind < 0.23:
            return f'<pre data-y="1">{self.text(1, 2)}</pre>'
        if kind < 0.26:
            return '<table data-y="1"><tr data-y="1">' + "".join(f'<td data-y="1">{self.words(2)}</td>' for _ in range(3)) + "</tr></table>"
        if kind < 0.3:
            return f'<p data-y="1"><b>{self.words(r.randint(1, 20))}<br>'
        if kind < 0.35:
            caption = f'<figcaption data-y="1">{self.words(r.randint(2, 16))}</figcaption>'
            return f'<figure{r.choice(["", self.named(_NEUTRAL)])} data-y="1"><img src="x.jpg">{caption}</figure>'
        if kind < 0.43:
            return f'<div{r.choice(["", "", self.named(_NEUTRAL)])} data-y="1">{self.inline(self.text(1, r.choice([1, 2, 4])))}</div>'
        if kind < 0.45:
            return f'<dl data-y="1"><dt data-y="1">{self.words(2)}</dt><dd data-y="1">{self.text(1, 2)}</dd></dl>'
        return f'<p data-y="1">{self.inline(self.text(1, r.choice([1, 2, 4, 9])))}' + r.choice(["</p>", "</p>", ""])

    def boiler(self, kind: str) -> str:
        r = self.r
        tag = {"nav": ["nav", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div"], "form": ["form"], "comments": ["section", "div"]}.get(kind, ["div", "section", "p"] if kind == "ad" else ["div"])
        tag = r.choice(tag)
        name = "" if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else self.named(_BOILER[kind])
        if kind == "nav":
            body = self.link_list()
        elif kind == "header":
            body = f'<div data-y="0">{self.words(2)}</div>' + (self.link_list() if r.random() < 0.4 else "")
        elif kind == "footer":
            body = r.choice(["&copy; ", "", "All rights reserved. "]) + self.text(1, 2) + (self.link_list() if r.random() < 0.3 else "")
        elif kind == "comments":
            body = f'<h3 data-y="0">{self.words(2)}</h3>' + "".join(f'<div data-y="0" class="{r.choice(["comment", "reply", "c"])}"><p data-y="0">{self.text(1, 3)}</p></div>' for _ in range(r.randint(1, 5)))
        elif kind == "form":
            body = f'<label>{self.words(2)}</label><input type="text"><button data-y="0">{self.words(1)}</button>'
        elif kind == "sidebar":
            body = f'<h3 data-y="0">{self.words(2)}</h3>' + r.choice([self.link_list(), f'<p data-y="0">{self.text(1, 3)}</p>'])
        else:
            inner = self.text(1, 3)
            body = inner if tag == "p" or r.random() < 0.6 else f'<p data-y="0">{inner}</p>'
        return f'<{tag}{name} data-y="0">{body}</{tag}>'

    def flat(self) -> str:
        """A page without a container."""
        r = self.r
        lines = r.choice(["<br>", "<br><br>", "\n"]).join(self.inline(self.text(1, 3)) for _ in range(r.randint(1, 6)))
        if r.random() < 0.4:
            return lines
        before, after = ("".join(map(self.boiler, r.sample(kinds, r.choice([0, 1, 2])))) for kinds in (["header", "nav", "ad", "notice"], ["comments", "sidebar", "footer", "ad"]))
        body = self.content() if r.random() < 0.6 else lines
        body = f'<body data-y="1">{before}{body}{after}</body>'
        return body if r.random() < 0.3 else f'<html data-y="0"><head data-y="0"><title>{self.words(4)}</title></head>{body}</html>'

    def page(self) -> str:
        r = self.r
        if r.random() < 0.2:
            return self.flat()
        before = [k for k in ("header", "nav", "ad", "notice", "form", "nav") if r.random() < 0.4]
        after = [k for k in ("share", "comments", "sidebar", "ad", "form", "footer", "notice") if r.random() < 0.35]
        tag, name = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", self.named(_CONTENT)), ("div", self.named(_CONTENT)), ("section", self.named(_CONTENT)), ("article", self.named(_CONTENT)), ("div", "")])
        inner = self.content()
        if r.random() < 0.15:
            inner += self.boiler("comments")
        if r.random() < 0.3:  # one container inside another
            inside, its = r.choice([("article", ""), ("div", self.named(_CONTENT)), ("section", ""), ("div", ""), ("div", self.named(_NEUTRAL))])
            inner = ("".join(map(self.boiler, r.sample(["nav", "ad", "share", "form"], r.choice([0, 0, 1])))) + f'<{inside}{its} data-y="1">{inner}</{inside}>')
        body = "".join(map(self.boiler, before)) + f'<{tag}{name} data-y="1">{inner}</{tag}>'
        if r.random() < 0.3:
            body += self.boiler("sidebar")
        body += "".join(map(self.boiler, after))
        if r.random() < 0.4:
            body = f'<div data-y="0"{r.choice(["", self.named(["wrap", "container", "page", "site", "layout", "with-sidebar", "no-header"])])}>{body}</div>'
        page = f'<!DOCTYPE html><html data-y="0"><head data-y="0"><title>{self.words(4)}</title><style>p{{}}</style></head><body data-y="0">{body}</body></html>'
        return page[: int(len(page) * r.uniform(0.6, 1))] if r.random() < 0.1 else page


def labelled_pages(count: int, seed: int) -> list[str]:
    return [Maker(seed * 100_003 + i).page() for i in range(count)]
