"""Reading the pages of sources that serve no data: list pages and lots' own pages as cards for the mappers.

Each reader is a table function over one page: it walks the page's tags once, whatever their nesting, and yields the
cards in it. Spark deals the pages; a page without cards yields nothing, and what a card does not tell is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions.times import month_rule_utc
from ..rules.tables import LOT_PAGES

CARD = "id string, slug string, title string, endText string, currentBid long, image string"
TERMS = "description string, purchaseFeePct double, auctionFeeKr double, itemVatRate double, images array<string>"
LOT = "title string, description string, stops string, valuation long, images array<string>"
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACE, _NAME = r"[ \t\n\r\f]", "[a-zA-Z][-a-zA-Z0-9_:.]*"
_ATTRS = rf"""((?:{_SPACE}++{_NAME}(?:="[^"]*"|='[^']*')?)*+){_SPACE}*+"""
#: Plain markup, which every HTML parser reads alike: a text, an opening tag with quoted values, a closing tag, a script
#: or style without other ends, a comment or doctype; then all that follows the first place that is not plain.
_PLAIN = re.compile(
    rf"([^<]++)|<(?:(?!(?i:script|style)[^a-zA-Z0-9])([a-zA-Z][a-zA-Z0-9]*+){_ATTRS}(/?)>|/([a-zA-Z][a-zA-Z0-9]*+){_SPACE}*+>|(script|style){_ATTRS}>((?:[^<]++|<(?!/))*+)</\6>|!(?:--[^-<>]*+(?:-[^-<>]++)*+--|(?i:doctype)[^<>]*+)>)|(<[\s\S]*+)"
)
_ATTR = re.compile(rf"""({_NAME})(?:="([^"]*)"|='([^']*)')?""")


def _pairs(attrs: str) -> list[tuple[str, str]]:
    told = _ATTR.findall(attrs)
    return [(k.lower(), unescape(v or w)) for k, v, w in told] if "&" in attrs else [(k.lower(), v or w) for k, v, w in told]


class Walk(HTMLParser):
    """Tags and texts of a page with the classes and ids of the open elements; ``seen`` gets every tag, ``said`` every
    text. Open elements are counted by tag and by name, so a page that closes nothing, or closes what was never open,
    costs no more than its length. Plain markup is told apart by one pattern; from the first place where it is not plain
    the parser of the library goes on."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.tags: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.around: str | None = ""

    def read(self, html: str) -> None:
        """The whole page."""
        for text, tag, attrs, closed, end, raw, raw_attrs, source, rest in _PLAIN.findall(html):
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            elif end:
                self.handle_endtag(end.lower())
            elif tag:
                (self.handle_startendtag if closed else self.handle_starttag)(tag.lower(), _pairs(attrs) if attrs else [])
            elif raw:
                self.handle_starttag(raw, _pairs(raw_attrs))
                self.handle_data(source)
                self.handle_endtag(raw)
            elif rest:
                self.feed(rest)
                self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = {k: v or "" for k, v in attrs} if attrs else {}
        if tag not in _VOID:
            name = f"{known.get('class', '')} {known.get('id', '')}".strip() if known else ""
            self.open.append((tag, name))
            self.tags[tag] = self.tags.get(tag, 0) + 1
            if name:
                self.names[name] = self.names.get(name, 0) + 1
                self.around = None
        self.seen(tag, known)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.seen(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        while self.tags.get(tag):
            last, name = self.open[-1]
            self.left(last, name)
            self.open.pop()
            self.tags[last] -= 1
            if name and self.names[name] > 1:
                self.names[name] -= 1
            elif name:
                del self.names[name]
                self.around = None
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.said(data)

    def within(self, name: str) -> bool:
        if self.around is None:
            self.around = "\0".join(self.names)
        return name in self.around

    def seen(self, tag: str, attrs: dict[str, str]) -> None: ...

    def said(self, text: str) -> None: ...

    def left(self, tag: str, classes: str) -> None: ...


def squeezed(parts: list[str]) -> str | None:
    return " ".join(" ".join(parts).split()) or None


def whole(text: str | None) -> int | None:
    """The number that a text's digits make, if over 0."""
    return int("".join(re.findall(r"\d", text or "")) or 0) or None


class _Cards(Walk):
    """Cards of a list page: a block for each lot, named by its number."""

    def __init__(self) -> None:
        super().__init__()
        self.cards: list[dict] = []

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "div" and attrs.get("class") == "item" and attrs.get("data-item-id", "").isdigit():
            self.cards.append({"id": attrs["data-item-id"], "slug": "", "title": None, "endText": None, "currentBid": None, "image": None})
        if not self.cards:
            return
        card = self.cards[-1]
        if tag == "a" and not card["slug"]:
            href = attrs.get("href", "")
            card["slug"] = next((m[1] for m in re.finditer(LOT_PAGES["link"], href, re.I) if href.startswith(card["id"], m.end(2))), "")
        if tag == "meta" and attrs.get("name") == "title" and card["title"] is None:
            card["title"] = squeezed([re.sub(r"<[^>]+>", " ", attrs.get("content", ""))])
        if card["image"] is None and re.search(r"\.(?:jpe?g|png|webp)$", attrs.get("data-src", ""), re.I):
            card["image"] = full_picture(attrs["data-src"])

    def said(self, text: str) -> None:
        if not self.cards:
            return
        card = self.cards[-1]
        if card["endText"] is None and self.within(LOT_PAGES["end"]):
            card["endText"] = text.strip()
        if card["currentBid"] is None and self.within(LOT_PAGES["bid"]) and "kr" in text:
            card["currentBid"] = whole(text)


def full_picture(address: str) -> str:
    """The path of a thumbnail's full picture."""
    path = re.sub(r"^https?://[^/]+", "", address)
    return re.sub(r"/tn/(?=\w)", "/", re.sub(r"/tn/small(?=\d)", "/", path))


class _Terms(Walk):
    """A lot's own page: its description, the buyer's terms, its pictures, each once by its number."""

    def __init__(self) -> None:
        super().__init__()
        self.text: list[str] = []
        self.done = False
        self.terms: dict[str, float | None] = {}
        self.main: str | None = None
        self.others: list[str] = []

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "div" and attrs.get("class", "").startswith(LOT_PAGES["terms"]) and not self.terms:
            number = lambda name: float(v) if re.fullmatch(r"\d+(?:\.\d+)?", v := attrs.get(name, "")) else None
            self.terms = {n: number(n) for n in LOT_PAGES["fees"]}
        if tag == "img" and attrs.get("itemprop") == "image" and self.main is None:
            self.main = attrs.get("src") or None
        elif tag == "img" and LOT_PAGES["pictures"] in attrs.get("data-src", ""):
            self.others.append(attrs["data-src"])

    def said(self, text: str) -> None:
        if not self.done and self.within(LOT_PAGES["description"]):
            self.text.append(text)

    def left(self, tag: str, classes: str) -> None:
        self.done = self.done or bool(self.text) and LOT_PAGES["description"] in classes

    def row(self) -> tuple:
        share, fixed, vat = (self.terms.get(n) for n in LOT_PAGES["fees"])
        if share is not None:
            fixed, vat = fixed or 0.0, vat or 0.0
        pictures: dict[str, str] = {}
        for address in [self.main, *self.others]:
            if address:
                m = re.search(r"(\d+)\.(?:jpe?g|png|webp)$", address, re.I)
                pictures.setdefault(m[1] if m else address, address)
        return squeezed(self.text), share, fixed if share is not None else None, vat if share is not None else None, list(pictures.values())


class _Lot(Walk):
    """A lot's own page without terms: title, first paragraph that is no small print, the end of its countdown."""

    def __init__(self) -> None:
        super().__init__()
        self.title: list[str] = []
        self.paragraph: list[str] = []
        self.description = self.stops = self.valuation = None
        self.told: list[str] = []
        self.inside = False

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if "countdown" in attrs.get("class", "") and self.stops is None:
            self.stops = attrs.get("title") or None
        if tag in _BLOCKS:  # a block ends a paragraph, closed or not
            self._end()
            self.inside = tag == "p"

    def said(self, text: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title.append(text)
        elif self.inside:
            self.paragraph.append(text)
        self.told.append(text)

    def left(self, tag: str, classes: str) -> None:
        if tag in _BLOCKS:
            self._end()
            self.inside = False

    def _end(self) -> None:
        text = squeezed(self.paragraph)
        self.paragraph = []
        if self.description is None and text and 15 <= len(text) <= 400 and not re.search(LOT_PAGES["small print"], text, re.I):
            self.description = text

    def row(self, html: str, lot: int) -> tuple:
        self._end()
        title = squeezed(self.title)
        worth = re.search(LOT_PAGES["worth"], " ".join(self.told))
        numbers = sorted({int(n) for n in re.findall(rf"/0*{lot}_(\d+)\.jpg", html, re.I)})
        pictures = [LOT_PAGES["picture"].format(lot=lot, n=n) for n in numbers or [1]]
        return title and (re.sub(LOT_PAGES["house"], "", title) or None), self.description, self.stops, whole(worth and worth[1]), pictures


def _fits(value, kind: pa.DataType):
    """``value`` without numbers that are too large for their type: those are not known."""
    if isinstance(value, list):
        return [_fits(v, kind.value_type) for v in value]
    if isinstance(value, tuple):
        return tuple(_fits(v, kind.field(i).type) for i, v in enumerate(value))
    return None if isinstance(value, int) and pa.types.is_integer(kind) and value.bit_length() >= kind.bit_width else value


def read_pages(pages: DataFrame, reader: UserDefinedTableFunction, *args: str) -> DataFrame:
    """What ``reader`` yields for each page, beside the page's other columns: the table function's rows, but handed over
    by batches, as going to and fro row by row costs more than reading a page. ``args``: its arguments, html first."""
    kind, told = reader.func, reader.returnType
    told = StructType.fromDDL(told) if isinstance(told, str) else told
    kept = [f for f in pages.schema.fields if f.name != "html"]
    types = [f.type for f in to_arrow_schema(told)]

    def batches(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = kind().eval
        for batch in batches_:
            columns, places, rows = [batch.column(a) for a in args], [], []
            for n in range(batch.num_rows):
                before = len(rows)
                rows.extend(read(*[c[n].as_py() for c in columns]))
                places.extend([n] * (len(rows) - before))
                if len(rows) >= 4096:
                    yield put(batch, places, rows)
                    places, rows = [], []
            if rows:
                yield put(batch, places, rows)

    def put(batch: pa.RecordBatch, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
        given = [batch.column(f.name).take(pa.array(places)) for f in kept]
        for values, type_ in zip(zip(*rows), types):
            try:
                given.append(pa.array(values, type_))
            except (OverflowError, pa.ArrowInvalid):
                given.append(pa.array([_fits(v, type_) for v in values], type_))
        return pa.RecordBatch.from_arrays(given, [f.name for f in (*kept, *told)])

    return pages.mapInArrow(batches, StructType([*kept, *told]))


@udtf(returnType=CARD)
class ListCards:
    def eval(self, html: str) -> Iterator[tuple]:
        page = _Cards()
        page.read(html or "")
        for c in page.cards:
            title = re.sub(r"^\d+\.\s*", "", c["title"] or c["slug"].replace("-", " "))
            yield c["id"], c["slug"], title, c["endText"], c["currentBid"], c["image"]


@udtf(returnType=TERMS)
class LotTerms:
    def eval(self, html: str) -> Iterator[tuple]:
        page = _Terms()
        page.read(html or "")
        yield page.row()


@udtf(returnType=LOT)
class LotFacts:
    def eval(self, html: str, lot: int) -> Iterator[tuple]:
        page = _Lot()
        page.read(html or "")
        yield page.row(html or "", lot or 0)


def gak_payloads(lists: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads for the mapper from list pages (html) and the lots' own pages (id, html); a lot without a page of its
    own has no detail."""
    cards = read_pages(lists, ListCards, "html").dropDuplicates(["id"])
    terms = read_pages(lots.select(F.col("id").cast("string"), "html"), LotTerms, "html")
    fee = F.when(F.col("purchaseFeePct").isNotNull(), F.struct("purchaseFeePct", "auctionFeeKr", "itemVatRate"))
    detail = terms.select("id", F.struct("description", "images", fee.alias("fee")).alias("detail"))
    item = F.struct(*[c.split()[0] for c in CARD.split(", ")])
    return cards.select("id", item.alias("item")).join(detail, "id", "left").select(F.to_json(F.struct("item", "detail")).alias("payload"))


def utc_text(local: Column) -> Column:
    """A local time as ISO text in UTC."""
    return F.date_format(month_rule_utc(F.try_to_timestamp(local).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def siko_payloads(live: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from live answers (id, bid, secondsRemaining) and the lots' own pages (id, html)."""
    facts = read_pages(lots, LotFacts, "html", "id")
    detail = facts.select("id", F.struct("title", "description", utc_text(F.col("stops")).alias("endsAt"), "images").alias("detail"))
    item = F.struct("id", "bid", "secondsRemaining")
    return live.select("id", item.alias("item")).join(detail, "id", "left").select(F.to_json(F.struct("item", "detail")).alias("payload"))
