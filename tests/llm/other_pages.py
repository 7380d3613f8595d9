"""Pages by a second generator, which shares nothing with the one that trains: (html, blocks of its article)."""

from __future__ import annotations

import random

_WORDS = "harbour council winter repair engine harvest letter market river quiet morning bridge paper signal garden teacher ticket cotton history museum weather planet doctor minister".split()


class Site:
    def __init__(self, seed: int) -> None:
        self.r, self.blocks = random.Random(seed), []

    def sentence(self, low=5, high=18) -> str:
        return " ".join(self.r.choice(_WORDS) for _ in range(self.r.randint(low, high))).capitalize() + "."

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 5)))

    def keep(self, tag: str, text: str) -> str:
        self.blocks.append(text)
        return f"<{tag}>{text}</{tag.split()[0]}>"

    def links(self, n: int) -> str:
        return "".join(f"<li><a href='#{i}'>{self.r.choice(_WORDS).title()}</a></li>" for i in range(n))

    def story(self) -> str:
        """Paragraphs, lists, pictures and sections in boxes as page builders nest them."""
        r, out = self.r, []
        for _ in range(r.randint(2, 7)):
            kind = r.choice(["p", "p", "p", "section", "box", "figure", "list", "quote", "text"])
            if kind == "section":
                out.append("<section>" + self.keep("h2", self.sentence(2, 5)[:-1]) + self.keep("p", self.prose()) + self.keep("p", self.prose()) + "</section>")
            elif kind == "box":
                out.append('<div class="elem-%d"><div class="holder">' % r.randint(1, 99) + self.keep("p", self.prose()) + self.keep("p", self.prose()) + "</div></div>")
            elif kind == "figure":
                out.append("<figure><picture><img src='a.webp'></picture>" + self.keep("figcaption", self.sentence(4, 9)) + "</figure>")
            elif kind == "list":
                out.append("<div><ul>" + "".join(self.keep("li", self.sentence(4, 12)) for _ in range(r.randint(2, 4))) + "</ul></div>")
            elif kind == "quote":
                out.append("<blockquote>" + self.keep("p", self.prose()) + "</blockquote>")
            elif kind == "text":
                out.append(self.keep("div", self.prose()))
            else:
                out.append(self.keep("p", self.prose()))
            if r.random() < 0.15:
                out.append(r.choice(['<div class="ad-unit">Advertisement</div>', f'<aside><h4>Read also</h4><ul>{self.links(3)}</ul></aside>', f'<div class="social-share"><a href="#">Share</a> <a href="#">Send</a></div>', '<form class="newsletter-signup"><label>Your mail</label><input><button>Join</button></form>']))
        return "".join(out)

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        top = r.choice([f"<header><a href='/'>The Daily</a><nav><ul>{self.links(5)}</ul></nav></header>", f"<div id='topbar' class='header'><div class='menu'><ul>{self.links(6)}</ul></div></div>", f"<nav role='navigation'><ul>{self.links(4)}</ul></nav>"])
        notice = r.choice(["", "<div class='cookie-consent'><p>We use cookies to make this site better.</p><button>Fine</button></div>"])
        title = self.keep("h1", self.sentence(3, 9)[:-1])
        body = self.story()
        shell = r.choice(["<article>%s%s</article>", "<main><div class='content'>%s%s</div></main>", "<main id='main'><article class='post'><header>%s</header><div class='entry-content'>%s</div></article></main>", "<div class='article'>%s<div>%s</div></div>", "<div class='page'><div class='article-body'><div>%s<section>%s</section></div></div></div>"]) % (title, body)
        comments = r.choice(["", "<section id='comments'><h3>Comments</h3>" + "".join(f"<div class='comment'><b>Reader</b><p>{self.sentence()}</p></div>" for _ in range(r.randint(1, 4))) + "</section>"])
        side = r.choice(["", f"<aside class='sidebar'><h3>Popular</h3><ul>{self.links(5)}</ul></aside>", f"<div class='related-posts'><h3>More</h3><p><a href='#'>{self.sentence()}</a></p></div>"])
        foot = f"<footer><p>&copy; 2024 The Daily. All rights reserved.</p><ul>{self.links(3)}</ul></footer>"
        return f"<!doctype html><html><head><title>x</title></head><body>{notice}{top}{shell}{comments}{side}{foot}</body></html>", self.blocks
