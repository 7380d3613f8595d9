"""Reading the list pages and lot pages of seven more houses as cards and details for their mappers.

A page is read tag by tag as in ``pages``. A reader names the elements whose text is a field; a list page begins a card
at each lot's element, and a lot met twice on a page is its first card. Null and empty pages, and pages without a lot,
yield no card; a lot's own page always yields one row, whose unknown fields are null. Who bids is never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from ..functions.times import exact_local, yearless
from ..rules.tables import HOUSE_PAGES
from .pages import Walk, read_pages, squeezed, whole

NET, FAB, BUD, BUK, BNA, BLI, KRO = (HOUSE_PAGES[h] for h in ("netauktion", "fabeo", "budi", "bukowskis", "bna", "blinto", "kronofogden"))
_LINES = frozenset("p li ul div h1 h2 h3 h4 h5 h6".split())


def first(pattern: str, text: str | None, group: int = 1) -> str | None:
    m = re.search(pattern, text or "", re.I)
    return m[group] if m else None


def shown(text: str | None) -> int | None:
    """The number that a text's digits make, nothing included; null without digits."""
    figures = re.findall(r"\d", text or "")
    return int("".join(figures)) if figures else None


def addresses(attrs: dict[str, str], pattern: str) -> list[str]:
    """The addresses in a tag's attributes."""
    return [m[0] for value in attrs.values() if "/" in value for m in re.finditer(pattern, value, re.I)] if attrs else []


class Card:
    """One lot of a page: its fields, the texts of its marked elements, and all that is said in it."""

    def __init__(self, key: str, depth: int = 0) -> None:
        self.key, self.depth = key, depth
        self.marks: dict[str, str] = {}
        self.fields: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {}
        self.done: set[str] = set()
        self.pictures: list[str] = []
        self.all: list[str] = []

    def text(self, name: str) -> str | None:
        return squeezed(self.texts.get(name, []))

    def said(self) -> str:
        return " ".join(" ".join(self.all).split())


class Marked(Walk):
    """Collects the text of the first element of each mark into the card that is open. ``marks`` gives the class or id of
    a field's element; ``{key}`` stands for the card's key. With ``closed``, a card ends where its element does."""

    marks: dict[str, str] = {}
    closed = False

    def __init__(self) -> None:
        super().__init__()
        self.cards: dict[str, Card] = {}
        self.card: Card | None = None

    def begin(self, key: str) -> None:
        self.card = self.cards[key] = Card(key, len(self.open))
        self.card.marks = {name: mark.format(key=key) for name, mark in self.marks.items()}

    def said(self, text: str) -> None:
        if self.card is None or (self.open and self.open[-1][0] in ("script", "style")):
            return
        self.card.all.append(text)
        for name, mark in self.card.marks.items():
            if name not in self.card.done and self.within(mark):
                self.card.texts.setdefault(name, []).append(text)

    def left(self, tag: str, classes: str) -> None:
        if self.card is None:
            return
        if classes:
            for name, mark in self.card.marks.items():
                if name in self.card.texts and mark in classes:
                    self.card.done.add(name)
        if self.closed and len(self.open) <= self.card.depth:
            self.card = None


class OnePage(Marked):
    """A lot's own page: one card from its start."""

    def __init__(self, key: str) -> None:
        super().__init__()
        self.closed = False
        self.begin(key)


def read(page: Walk, html: str | None):
    page.read(html or "")
    return page


# Netauktion: list cards, the history of bids in a status answer, the lot's own page.


class _NetList(Marked):
    marks = {"title": NET["title"]}
    closed = True

    def __init__(self) -> None:
        super().__init__()
        self.facts: dict[str, list[list[str]]] = {}

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        names = attrs.get("class", "")
        if tag == "article" and NET["card"] in names and attrs.get("id", "").isdigit():
            if attrs["id"] in self.cards:
                self.card = None
            else:
                self.begin(attrs["id"])
            return
        if self.card is None:
            return
        if tag == "a" and "slug" not in self.card.fields and (slug := first(NET["link"], attrs.get("href"))):
            self.card.fields["slug"] = slug
        if tag == "img" and NET["picture"] in attrs.get("src", "") and not self.card.pictures:
            self.card.pictures.append(net_picture(attrs["src"]))
        if NET["fact"] in names:
            self.facts.setdefault(self.card.key, []).append([])

    def said(self, text: str) -> None:
        super().said(text)
        if self.card is not None and self.within(NET["fact"]) and self.facts.get(self.card.key):
            self.facts[self.card.key][-1].append(text)

    def fact(self, key: str, label: str) -> str | None:
        told = (squeezed(f) or "" for f in self.facts.get(key, []))
        return next((t[len(label) :].strip() or None for t in told if t.lower().startswith(label.lower())), None)


def net_picture(address: str) -> str:
    """The address of a thumbnail's large picture."""
    return re.sub(NET["thumbnail"], NET["large"], urljoin(NET["origin"], address), flags=re.I)


@udtf(returnType="id string, slug string, title string, location string, endText string, image string")
class NetauktionCards:
    def eval(self, html: str) -> Iterator[tuple]:
        page = read(_NetList(), html)
        for c in page.cards.values():
            if "slug" in c.fields:
                end = page.fact(c.key, NET["end"])
                yield c.key, c.fields["slug"], c.text("title"), page.fact(c.key, NET["place"]), end if first(r"(\d{4}-\d{2}-\d{2})", end) else None, next(iter(c.pictures), None)


class _BidBox(Walk):
    """Rows of a list of bids: value in bold, day and time around a line break, and whether a machine bid."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "li" and "row" in attrs.get("class", "").split():
            self.rows.append({"value": None, "said": []})

    def said(self, text: str) -> None:
        if self.rows:
            row = self.rows[-1]
            row["said"].append(text)
            if row["value"] is None and self.open and self.open[-1][0] == "b":
                row["value"] = shown(first(NET["bid"], text))


@udtf(returnType="value long, at string, auto boolean")
class NetauktionBids:
    def eval(self, html: str) -> Iterator[tuple]:
        for row in read(_BidBox(), html).rows:
            said = squeezed(row["said"]) or ""
            at = re.search(r"(\d{4}-\d{2}-\d{2})\D*(\d{1,2}:\d{2}(?::\d{2})?)", said)
            if row["value"] is not None:
                yield row["value"], at and f"{at[1]} {at[2]}", NET["auto"] in said.lower()


class _NetLot(OnePage):
    """The description's element, and the pictures of the lot's own gallery among those of others."""

    marks = {name: name for name in NET["description"]}

    def __init__(self, key: str) -> None:
        super().__init__(key)
        self.own = False

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if gallery := first(NET["gallery"] + r"(\d+)", attrs.get("class")):
            self.own = gallery == self.card.key
        if self.own and tag == "a" and attrs.get("itemprop") == "contentUrl" and attrs.get("href", "").startswith(NET["picture"]):
            if (large := net_picture(attrs["href"])) not in self.card.pictures:
                self.card.pictures.append(large)


@udtf(returnType="description string, images array<string>")
class NetauktionLot:
    def eval(self, html: str, key: str) -> Iterator[tuple]:
        c = read(_NetLot(key or ""), html).card
        described = next((t for name in NET["description"] if (t := c.text(name))), None)
        yield described or (first(NET["undivided"], c.said()) or "").strip() or None, c.pictures


def netauktion_payloads(lists: DataFrame, status: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from list pages (html), status answers (payload: a JSON array) and lots' own pages (id, html). A lot
    without an answer ends when its card says; bids are counted where an answer lists them or has none."""
    cards = read_pages(lists, NetauktionCards, "html").dropDuplicates(["id"])
    fields = "product_id:string,top_bid:string,top_bid_with_fee_and_tax:string,is_over_resprice:string,reserve_met:string,expiration_datetime:string,is_active:string,next_ok_bid:string,fee:double,bid_box:string"
    told = status.select(F.explode(F.from_json("payload", f"array<struct<{fields}>>")).alias("s")).select("s.*").dropDuplicates(["product_id"])
    bids = F.size(F.regexp_extract_all(F.coalesce("bid_box", F.lit("")), F.lit(r'(<li class="row">)'), F.lit(1)))
    none = F.coalesce(F.col("top_bid").try_cast("double"), F.lit(0.0)) <= 0
    told = told.withColumns({"bid_count": F.when((bids > 0) | none, bids), "reserve_met": F.coalesce("reserve_met", F.lit("false"))}).drop("bid_box").withColumnRenamed("product_id", "id")
    own = read_pages(lots.select(F.col("id").cast("string"), "html"), NetauktionLot, "html", "id")
    rows = cards.join(told.withColumn("answered", F.lit(True)), "id", "left").join(own, "id", "left")
    ends = F.coalesce("expiration_datetime", "endText")
    active = F.when(F.col("answered"), F.col("is_active")).otherwise("true")
    item = F.struct(
        F.col("id").alias("product_id"), "title", "slug", "location", "description", F.when(F.size("images") > 0, F.col("images")).otherwise(F.array_compact(F.array("image"))).alias("images"), "top_bid", "top_bid_with_fee_and_tax", "is_over_resprice", "reserve_met",
        ends.alias("expiration_datetime"), active.alias("is_active"), "next_ok_bid", "fee", "bid_count")
    return rows.select(F.to_json(F.array(item)).alias("payload"))


def netauktion_bids(status: DataFrame) -> DataFrame:
    """Bids of the status answers under ids made of lot, time and value; who bid is left out."""
    told = status.select(F.explode(F.from_json("payload", "array<struct<product_id:string,bid_box:string>>")).alias("s")).select(F.col("s.product_id").alias("item_external_id"), F.col("s.bid_box").alias("html"))
    rows = read_pages(told, NetauktionBids, "html")
    key = F.concat_ws(":", "item_external_id", F.coalesce("at", F.lit("")), F.col("value").cast("string"))
    return rows.select(key.alias("external_id"), "item_external_id", "value", F.when(F.col("auto"), "auto").otherwise("normal").alias("type"), exact_local(F.col("at")).alias("created_at"))


# Fabeo: the page of a product tells what the shop's catalogue leaves out.


class _FabLot(OnePage):
    """Price and end of the product asked for, among those of related ones, and the table of bids."""

    def __init__(self, key: str) -> None:
        super().__init__(key)
        self.bid: str | None = None
        self.price: list[str] = []
        self.waiting = False
        self.end: str | None = None
        self.any_end: str | None = None
        self.rows: list[dict] = []
        self.met: set[str] = set()

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        f = self.card.fields
        for name in ("met", "not met"):
            if any(FAB[name] in v for v in attrs.values()):
                self.met.add(name)
        if attrs.get("data-auction-id") == self.card.key and "status" not in f and attrs.get("data-bid", "").isdigit():
            f["status"], self.bid, self.waiting = attrs.get("data-status") or None, attrs["data-bid"], True
        if FAB["end"] in attrs.get("class", "") and attrs.get("data-time", "").isdigit():
            self.any_end = self.any_end or attrs["data-time"]
            if attrs.get("data-auctionid") == self.card.key:
                self.end = self.end or attrs["data-time"]
        if tag == "tr":
            key = first(FAB["bid row"], attrs.get("id"))
            if key and "bid" in attrs.get("class", "").split():
                self.rows.append({"key": key, "date": [], "bid": []})

    def said(self, text: str) -> None:
        super().said(text)
        priced = self.within(FAB["price"])
        if self.waiting and priced:
            self.price.append(text)
            self.waiting = False
        if self.rows:
            cell = next((names for tag, names in reversed(self.open) if tag == "td"), "").split()
            if "date" in cell:
                self.rows[-1]["date"].append(text)
            elif "bid" in cell and priced and not self.rows[-1]["bid"]:
                self.rows[-1]["bid"].append(text)

    def row(self) -> tuple:
        said = self.card.said()
        bid = shown(self.bid) or None
        price = shown(squeezed(self.price))
        vat = 0.0 if first(f"({FAB['exempt']})", said) else float(first(FAB["vat"], said) or 25)
        if first(f"({FAB['no reserve']})", said):
            met = None
        elif self.met:
            met = "met" in self.met
        else:
            met = False if first(f"({FAB['said not met']})", said) else True if first(f"({FAB['said met']})", said) else None
        bids = [(r["key"], value, squeezed(r["date"])) for r in self.rows if (value := shown(squeezed(r["bid"]))) is not None]
        count = shown(first(FAB["count"], said))
        return (
            int(e) if (e := self.end or self.any_end) else None, self.card.fields.get("status"), price if bid is None else shown(first(FAB["start"], said)), bid, len(bids) if count is None else count, met,
            shown(first(FAB["fee"], said)), vat, shown(first(FAB["step"], said)), bids)


@udtf(returnType="endUnix long, status string, startBid long, currentBid long, bidCount int, reserveMet boolean, feeValue long, vatRate double, step long, bids array<struct<id:string,value:long,at:string>>")
class FabeoLot:
    def eval(self, html: str, key: str) -> Iterator[tuple]:
        yield read(_FabLot(key or ""), html).row()


def fabeo_payloads(products: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from the catalogue's products (payload: a JSON object) and the lots' own pages (id, html)."""
    kind = "struct<id:long,name:string,description:string,short_description:string,permalink:string,images:array<struct<src:string>>,prices:struct<currency_code:string>>"
    rows = products.select(F.from_json("payload", kind).alias("item")).withColumn("id", F.col("item.id").cast("string")).filter("id IS NOT NULL").dropDuplicates(["id"])
    told = read_pages(lots.select(F.col("id").cast("string"), "html"), FabeoLot, "html", "id")
    detail = told.select("id", F.struct("endUnix", "status", "startBid", "currentBid", "bidCount", "reserveMet", "feeValue", "vatRate").alias("detail"))
    return rows.join(detail, "id", "left").select(F.to_json(F.struct("item", "detail")).alias("payload"))


def fabeo_bids(lots: DataFrame, as_of: Column) -> DataFrame:
    """Bids of the lots' own pages; their dates lack the year and lie in the past."""
    told = read_pages(lots.select(F.col("id").cast("string"), "html"), FabeoLot, "html", "id").select(F.col("id").alias("item_external_id"), F.explode("bids").alias("b"))
    return told.select(F.col("b.id").alias("external_id"), "item_external_id", F.col("b.value").alias("value"), F.lit("normal").alias("type"), yearless(F.col("b.at"), as_of, past=True).alias("created_at"))


# Bukowskis: a card begins at its lot number and runs to the next one.


class _BukList(Marked):
    def __init__(self) -> None:
        super().__init__()
        self.end: str | None = None

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        before, self.end = self.end, attrs.get("data-end-date")
        if attrs.get("data-lot-id", "").isdigit():
            if attrs["data-lot-id"] in self.cards:
                self.card = None
            else:
                self.begin(attrs["data-lot-id"])
                if (end := self.end or before or "").isdigit():
                    self.card.fields["end"] = end
        if self.card is None:
            return
        f = self.card.fields
        if tag == "a" and "href" not in f and (m := re.match(BUK["link"], attrs.get("href", ""))):
            f["href"], f["code"] = attrs["href"], m[1] or ""
        if attrs.get("alt") and "title" not in f:
            f["title"] = attrs["alt"].strip()
        self.card.pictures += [a for a in dict.fromkeys(addresses(attrs, BUK["picture"])) if a not in self.card.pictures]


@udtf(returnType="lotId string, auctionCode string, title string, href string, endUnix long, estimate long, currentBid long, currency string, images array<string>")
class BukowskisCards:
    def eval(self, html: str) -> Iterator[tuple]:
        for c in read(_BukList(), html).cards.values():
            if "href" in c.fields:
                said = c.said()
                bid, worth = re.search(BUK["bid"], said), re.search(BUK["estimate"], said)
                none = BUK["none"] in said
                coin = next((m[2] for m in (bid, worth) if m), "SEK")
                yield c.key, c.fields["code"], c.fields.get("title", ""), c.fields["href"], shown(c.fields.get("end")), shown(worth and worth[1]), None if none else shown(bid and bid[1]), coin, c.pictures


class _BukLot(OnePage):
    """The paragraphs of the description, or its text if it has none."""

    marks = {"description": BUK["description"]}

    def __init__(self) -> None:
        super().__init__("")
        self.paragraphs: list[list[str]] = []

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "p" and "description" not in self.card.done and self.within(BUK["description"]):
            self.paragraphs.append([])

    def said(self, text: str) -> None:
        super().said(text)
        if self.paragraphs and self.tags.get("p") and "description" not in self.card.done and self.within(BUK["description"]):
            self.paragraphs[-1].append(text)


@udtf(returnType="description string")
class BukowskisLot:
    def eval(self, html: str) -> Iterator[tuple]:
        page = read(_BukLot(), html)
        paragraphs = [t for p in page.paragraphs if (t := squeezed(p))]
        yield ("\n".join(paragraphs) or page.card.text("description"),)


def bukowskis_payloads(lists: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from list pages (html) and the lots' own pages (id, html)."""
    cards = read_pages(lists, BukowskisCards, "html").dropDuplicates(["lotId"])
    own = read_pages(lots.select(F.col("id").cast("string").alias("lotId"), "html"), BukowskisLot, "html")
    item = F.struct("lotId", "auctionCode", "title", "href", "endUnix", "estimate", "currentBid", "currency", "images")
    detail = own.select("lotId", F.struct("description").alias("detail"))
    return cards.select("lotId", item.alias("item")).join(detail, "lotId", "left").select(F.to_json(F.struct("item", "detail")).alias("payload"))


# BNA: events, the lots of an event, a lot's own page.


class _Links(Walk):
    def __init__(self) -> None:
        super().__init__()
        self.found: dict[tuple[str, str], tuple[str, str | None]] = {}

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        href = attrs.get("href", "")
        if m := re.fullmatch(BNA["event"], href):
            self.found.setdefault(("event", m[2]), (href, squeezed([m[1].replace("-", " ")])))
        elif m := re.fullmatch(BNA["lot"], href):
            self.found.setdefault(("lot", m[1]), (href, None))


@udtf(returnType="kind string, key string, href string, title string")
class BnaLinks:
    """The events and lots that a page links to, each once."""

    def eval(self, html: str) -> Iterator[tuple]:
        for (kind, key), (href, title) in read(_Links(), html).found.items():
            yield kind, key, href, title


class _BnaLot(OnePage):
    def __init__(self) -> None:
        super().__init__("")
        self.title: list[str] = []
        self.headed = False

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        for value in attrs.values():
            self.card.pictures += [p for m in re.finditer(BNA["picture"], value) if (p := BNA["full"].format(m[1])) not in self.card.pictures]
            if "end" not in self.card.fields and (end := first(f"({BNA['end']})", value)):
                self.card.fields["end"] = end

    def said(self, text: str) -> None:
        super().said(text)
        if "end" not in self.card.fields and (end := first(f"({BNA['end']})", text)):
            self.card.fields["end"] = end
        if self.tags.get("h1") and not self.headed:
            self.title.append(text)

    def left(self, tag: str, classes: str) -> None:
        super().left(tag, classes)
        self.headed = self.headed or tag == "h1"


@udtf(returnType="title string, endsLocal string, currentBid long, minBid long, vatRate double, location string, images array<string>")
class BnaLot:
    def eval(self, html: str) -> Iterator[tuple]:
        page = read(_BnaLot(), html)
        said = page.card.said()
        place = re.search(BNA["place"], "\n".join(squeezed([t]) for t in page.card.all))
        title = re.sub(r"^\d+\.\s*", "", squeezed(page.title) or "")
        yield title, page.card.fields.get("end"), shown(first(BNA["bid"], said)), shown(first(BNA["least"], said)), 25.0 if first(f"({BNA['vat']})", said) else 0.0, place and place[1].strip(), page.card.pictures


def bna_payloads(events: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from the events' pages (event, html) and the lots' own pages (href, html); lots whose page was not read
    are left out, as the events tell nothing but their address."""
    links = read_pages(events.select(F.col("event").cast("string").alias("eventId"), "html"), BnaLinks, "html").filter("kind = 'lot'")
    own = read_pages(lots, BnaLot, "html")
    rows = links.select("eventId", F.col("key").alias("itemId"), "href").dropDuplicates(["itemId"]).join(own, "href")
    item = F.struct("itemId", "eventId", "title", "href", "location", "endsLocal", "minBid", "currentBid", "vatRate", "images")
    return rows.select(F.to_json(F.struct(item.alias("item"))).alias("payload"))


# Blinto: cards of the first page, answers on bids, a lot's own page.


def blinto_picture(address: str) -> str:
    """A picture's large form: without query and size, with the largest size where the store cuts sizes."""
    bare = re.sub(r"/\d+x\d+\w*$", "", address.partition("?")[0])
    return bare + BLI["large"] if BLI["cdn"] in bare else bare


class _BliList(Marked):
    marks = {"type": BLI["kind"], "title": BLI["title"], "location": BLI["place"], "end": BLI["end"] + "{key}"}
    closed = True

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "a" and (m := re.fullmatch(BLI["link"], attrs.get("href", ""))):
            if m[1] in self.cards:
                self.card = None
            else:
                self.begin(m[1])
                self.card.fields |= {"href": attrs["href"], "auction": m[2]}
        if self.card is not None and not self.card.pictures:
            self.card.pictures += [blinto_picture(a) for a in addresses(attrs, BLI["picture"])[:1]]


@udtf(returnType="objId string, aucId string, href string, type string, title string, location string, endText string, bidCount int, currentBid long, image string")
class BlintoCards:
    def eval(self, html: str) -> Iterator[tuple]:
        for c in read(_BliList(), html).cards.values():
            said = c.said()
            end = first(f"({BLI['date']})", c.text("end"))
            yield (
                c.key, c.fields["auction"], c.fields["href"], c.text("type"), c.text("title") or c.text("type") or "", c.text("location"), end, shown(first(BLI["bids"], said)), whole(first(BLI["bid"], said)), next(iter(c.pictures), None))


class _BliLot(OnePage):
    """Fee, VAT and pictures of a lot; its description by lines, up to what the house writes under every lot."""

    def __init__(self, key: str) -> None:
        super().__init__(key)
        self.lines: list[str] = []

    def _in(self) -> bool:
        return "description" not in self.card.done and self.within(BLI["description"])

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        for address in addresses(attrs, BLI["picture"]):
            if (f"/object/{self.card.key}/" if BLI["cdn"] in address else self.card.key) in address and (large := blinto_picture(address)) not in self.card.pictures:
                self.card.pictures.append(large)
        if self._in():
            if tag == "li":
                self.lines.append("\n- ")
            elif tag == "br":
                self.lines.append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs) if tag in ("br", "img") else super().handle_startendtag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self._in():
            self.lines.append(data)
        super().handle_data(data)

    def left(self, tag: str, classes: str) -> None:
        if self._in():
            if BLI["description"] in classes:
                self.card.done.add("description")
            elif tag in _LINES:
                self.lines.append("\n")

    def description(self) -> str | None:
        text = re.split(BLI["house text"], "".join(self.lines), maxsplit=1, flags=re.I)[0]
        lines = (" ".join(line.split()) for line in text.split("\n"))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() or None


@udtf(returnType="feeValue long, vatRate double, images array<string>, description string")
class BlintoLot:
    def eval(self, html: str, key: str) -> Iterator[tuple]:
        page = read(_BliLot(key or ""), html)
        said = page.card.said()
        free = re.search(BLI["exempt"], said) and not re.search(BLI["vat"], said)
        yield shown(first(BLI["fee"], said)), 0.0 if free else 25.0, page.card.pictures, page.description()


def blinto_live(answers: DataFrame) -> DataFrame:
    """Answers of the form 'auction|bid|..|end|..|least next bid' (answer) as columns; others are dropped. The fields are
    the first, second, fourth and eleventh."""
    parts = F.split(F.trim("answer"), r"\|")
    field = lambda k: F.trim(F.get(parts, k))
    number = lambda k: F.when(field(k).rlike(r"^\d+$"), field(k).try_cast("long"))
    rows = answers.filter(~F.contains("answer", F.lit("<")) & field(0).rlike(r"^\d+$"))
    return rows.select(field(0).alias("aucId"), number(1).alias("bid"), F.when(field(3).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}"), field(3)).alias("endsAtRaw"), number(10).alias("nextMinBid")).dropDuplicates(["aucId"])


def blinto_counts(answers: DataFrame) -> DataFrame:
    """Answers ``{auction: {maxbid, numbid}}`` (payload) as columns, numbers without their units."""
    number = lambda f: F.nullif(F.regexp_replace(f"told.{f}", r"\D", ""), F.lit("")).try_cast("long")
    rows = answers.select(F.explode(F.from_json("payload", "map<string,struct<maxbid:string,numbid:string>>")).alias("aucId", "told"))
    return rows.select("aucId", number("maxbid").alias("maxbid"), number("numbid").cast("int").alias("numbid")).dropDuplicates(["aucId"])


def blinto_payloads(lists: DataFrame, live: DataFrame, counts: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from list pages (html), both kinds of answers, and the lots' own pages (id, html). What an answer tells
    goes before what the card does."""
    cards = read_pages(lists, BlintoCards, "html").dropDuplicates(["objId"])
    rows = cards.join(blinto_live(live), "aucId", "left").join(blinto_counts(counts), "aucId", "left")
    item = F.struct("objId", "href", "type", "title", "location", "endText", "endsAtRaw", "nextMinBid", F.coalesce("numbid", "bidCount").alias("bidCount"), F.coalesce("bid", "maxbid", "currentBid").alias("currentBid"), "image")
    own = read_pages(lots.select(F.col("id").cast("string").alias("objId"), "html"), BlintoLot, "html", "objId")
    detail = own.select("objId", F.struct("feeValue", "vatRate", "images", "description").alias("detail"))
    return rows.select("objId", item.alias("item")).join(detail, "objId", "left").select(F.to_json(F.struct("item", "detail")).alias("payload"))


# Kronofogden: cards with live facts, a lot's own page.


def kfm_picture(address: str) -> str:
    return re.sub(KRO["size"], "", address, flags=re.I)


class _KroList(Marked):
    marks = {"bid": KRO["bid"] + "{key}", "clock": KRO["clock"] + "{key}"}

    def __init__(self) -> None:
        super().__init__()
        self.after = ""

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "div" and KRO["card"] in attrs.get("class", "") and attrs.get("id", "").isdigit():
            self.card = None
            if attrs["id"] not in self.cards:
                self.begin(attrs["id"])
            self.after = ""
        if self.card is None:
            return
        if tag == "a" and "auction" not in self.card.fields and (m := re.fullmatch(KRO["link"], attrs.get("href", ""))):
            self.card.fields |= {"auction": m[1], "number": m[2]}
        if not self.card.pictures:
            self.card.pictures += [kfm_picture(a) for a in addresses(attrs, KRO["picture"].format(id=self.card.key))[:1]]
        if tag == "br" and self.after == "title":
            self.after = "over"
        if KRO["place"] in attrs.get("class", "") and self.within(KRO["facts"]):
            self.after = "place"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs) if tag in ("br", "img") else super().handle_startendtag(tag, attrs)

    def said(self, text: str) -> None:
        super().said(text)
        if self.card is not None and self.after in ("title", "place") and self.within(KRO["facts"]):
            self.card.texts.setdefault("the " + self.after, []).append(text)

    def left(self, tag: str, classes: str) -> None:
        super().left(tag, classes)
        if self.after == "" and KRO["number"] in classes and self.within(KRO["facts"]):
            self.after = "title"
        elif tag == "small" and self.after == "place":
            self.after = "over"


@udtf(returnType="objId string, inA string, inO string, title string, location string, startBid long, currentBid long, countdown string, image string")
class KronofogdenCards:
    def eval(self, html: str) -> Iterator[tuple]:
        for c in read(_KroList(), html).cards.values():
            if "auction" in c.fields:
                bid = c.text("bid") or ""
                amount = shown(first(KRO["amount"], bid))
                start = KRO["start"] in bid.lower()
                title = c.text("the title") or f"Kronofogden {c.key}"
                yield c.key, c.fields["auction"], c.fields["number"], title, c.text("the place"), amount if start else None, None if start else amount, c.text("clock"), next(iter(c.pictures), None)


class _KroLot(OnePage):
    """The first paragraph of the block that is set off from the top, by lines."""

    def __init__(self, key: str) -> None:
        super().__init__(key)
        self.state, self.lines = "before", []

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        for address in addresses(attrs, KRO["picture"].format(id=re.escape(self.card.key))):
            if (full := kfm_picture(address)) not in self.card.pictures:
                self.card.pictures.append(full)
        if self.state == "before" and KRO["description"] in attrs.get("style", "").replace(" ", ""):
            self.state = "block"
        elif self.state == "block":
            self.state = "inside" if tag == "p" else "before"
        elif self.state == "inside" and tag == "br":
            self.lines.append("\n")
        elif self.state == "inside" and tag == "p":
            self.state = "over"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs) if tag in ("br", "img") else super().handle_startendtag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.state == "inside":
            self.lines.append(" ".join(data.split("\n")))
        super().handle_data(data)

    def left(self, tag: str, classes: str) -> None:
        if self.state == "inside" and tag == "p":
            self.state = "over"

    def description(self) -> str | None:
        text = "\n".join(" ".join(line.split()) for line in "".join(self.lines).split("\n"))
        said = re.sub(r"\n{3,}", "\n\n", text).strip()
        cut = re.search(KRO["house text"], said, re.I)
        return (said[: cut.start()].strip() if cut and cut.start() else said) or None


@udtf(returnType="description string, images array<string>")
class KronofogdenLot:
    def eval(self, html: str, key: str) -> Iterator[tuple]:
        page = read(_KroLot(key or ""), html)
        yield page.description(), page.card.pictures


def kronofogden_payloads(lists: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from list pages (html) and the lots' own pages (id, html)."""
    cards = read_pages(lists, KronofogdenCards, "html").dropDuplicates(["objId"])
    item = F.struct("objId", "inA", "inO", "title", "location", "startBid", "currentBid", "countdown", "image")
    own = read_pages(lots.select(F.col("id").cast("string").alias("objId"), "html"), KronofogdenLot, "html", "objId")
    return cards.select("objId", item.alias("item")).join(own.select("objId", F.struct("description", "images").alias("detail")), "objId", "left").select(F.to_json(F.struct("item", "detail")).alias("payload"))


# Budi: a card is a link with the lot's facts as attributes; live answers on bids; fee and gallery on the lot's page.


def budi_picture(address: str) -> str:
    """A picture in a middle size; other addresses as they are."""
    path = re.search(r"/cdn-cgi/image/[^/]+/(.+)$", address)
    return BUD["large"] + path[1] if path else address


class _BudList(Marked):
    marks = {"amount": BUD["amount"], "count": BUD["count"]}
    closed = True

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        told = {k.removeprefix(BUD["lot"]): v for k, v in attrs.items() if k.startswith(BUD["lot"])}
        if tag == "a" and told.get("id", "").isdigit():
            if told["id"] in self.cards:
                self.card = None
                return
            self.begin(told["id"])
            self.card.fields |= {"href": attrs.get("href", ""), "ends": told.get("endingdatetimeiso", ""), "ended": told.get("isended", ""), "city": told.get("citykey", "")}
        if self.card is None:
            return
        if attrs.get("title") and "title" not in self.card.fields and self.within(BUD["title"]):
            self.card.fields["title"] = " ".join(attrs["title"].split())
        if tag == "img":
            if attrs.get("src") and not self.card.pictures:
                self.card.pictures.append(budi_picture(attrs["src"]))
            if attrs.get("alt"):
                self.card.fields.setdefault("alt", " ".join(attrs["alt"].split()))


@udtf(returnType="id string, title string, location string, endsAt string, ended boolean, amount long, bidCount int, sourceUrl string, image string")
class BudiCards:
    def eval(self, html: str) -> Iterator[tuple]:
        for c in read(_BudList(), html).cards.values():
            f = c.fields
            yield c.key, f.get("title") or f.get("alt") or f"Budi {c.key}", f["city"] or None, f["ends"] or None, f["ended"] == "true", whole(c.text("amount")), shown(c.text("count")) or 0, urljoin(BUD["origin"], f["href"] or f"/objekt/{c.key}"), next(iter(c.pictures), None)


class _BudLot(Walk):
    """Description, terms of the fee, and the pictures that share the card's folder and number."""

    def __init__(self, image: str | None) -> None:
        super().__init__()
        self.base = first(BUD["gallery"], image)
        self.description: str | None = None
        self.fee: dict[str, float] = {}
        self.paths: set[str] = set()

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "meta" and attrs.get("name") == "description" and self.description is None:
            self.description = squeezed([attrs.get("content", "")])
        for name, value in attrs.items():
            if name.startswith(BUD["fee"]) and re.fullmatch(r"\d+(?:\.\d+)?", value):
                self.fee.setdefault(name.removeprefix(BUD["fee"]), float(value))
        if self.base:
            self.paths |= {p for p in addresses(attrs, BUD["picture"]) if first(BUD["gallery"], p) == self.base}

    def row(self) -> tuple:
        ordered = sorted(self.paths, key=lambda p: (int(first(BUD["place"], p) or 0), p))
        fixed, share = self.fee.get("exvat"), self.fee.get("dynpercentage-bps", 0.0)
        fee = (share, self.fee.get("dynminexvat", 0.0), fixed) if fixed is not None or share > 0 else None
        return self.description if self.description and len(self.description) > 2 else None, fee, [BUD["large"] + p for p in ordered]


@udtf(returnType="description string, feeParams struct<dynBps:double,dynMinExVat:double,fixedExVat:double>, images array<string>")
class BudiLot:
    def eval(self, html: str, image: str) -> Iterator[tuple]:
        yield read(_BudLot(image), html).row()


def budi_payloads(lists: DataFrame, answers: DataFrame, lots: DataFrame) -> DataFrame:
    """Payloads from catalogue pages (html), live answers (payload) and lots' own pages (id, html). What an answer tells
    goes before what the card does; a card's price is the bid if there are bids, else the least one."""
    cards = read_pages(lists, BudiCards, "html").dropDuplicates(["id"])
    amount = "struct<exVat:double,vatPercentage:double>"
    told = answers.select(F.explode(F.from_json("payload", f"struct<items:array<struct<auctionObjectId:string,bidCurrentAmount:{amount},bidNextAmount:{amount},bidCount:int,isReservationPriceMet:boolean,isEnded:boolean,isBiddingOpen:boolean,endingDateTimeIso:string>>>")["items"]).alias("a"))
    told = told.select(F.col("a.auctionObjectId").alias("id"), F.col("a").alias("t")).dropDuplicates(["id"])
    rows = cards.join(told, "id", "left")
    live, false = F.col("t").isNotNull(), F.lit(False)
    count = F.when(live, F.coalesce("t.bidCount", F.lit(0))).otherwise(F.col("bidCount"))
    now, following = (F.when(F.col(f"t.{c}.exVat") > 0, F.col(f"t.{c}.exVat").cast("long")) for c in ("bidCurrentAmount", "bidNextAmount"))
    bid = F.when(live, F.when(count > 0, now)).when(count > 0, F.col("amount"))
    rows = rows.select(
        "id", "title", "location", "sourceUrl", "image", count.alias("bidCount"), bid.alias("currentBid"), F.when(bid.isNull(), F.coalesce(following, "amount")).alias("minBid"), F.when(live, F.coalesce("t.isReservationPriceMet", false)).alias("reserveMet"),
        F.col("t.bidCurrentAmount.vatPercentage").alias("vatPercentage"), F.coalesce("t.endingDateTimeIso", "endsAt").alias("endsAt"), (F.col("ended") | (live & (F.coalesce("t.isEnded", false) | ~F.coalesce("t.isBiddingOpen", false)))).alias("ended"))
    own = read_pages(lots.select(F.col("id").cast("string"), "html").join(cards.select("id", "image"), "id"), BudiLot, "html", "image").select("id", "description", "feeParams", "images")
    rows = rows.join(own, "id", "left")
    return rows.select(F.to_json(F.struct(F.struct(*[c for c in rows.columns]).alias("item"))).alias("payload"))
