"""Mappers of sources whose lots come as list cards with, now and then, facts from the lot's own page.

A payload is ``{"item": card, "detail": facts or null}``. Cards of two sources are read from their pages here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import half_up
from ..functions.text import digits, strip_html
from ..functions.times import countdown_seconds, exact_local, yearless
from ..rules.tables import LOT_FACT, METROPOL_CARD, NO_FACT, PANTBANKEN_CARD
from .contract import conform, reserve, status_at
from .houses import instant, parsed
from .houses_lists import no_blanks, positive


def i(c: str) -> Column:
    return F.col(f"d.item.{c}")


def x(c: str) -> Column:
    return F.col(f"d.detail.{c}")


def pictures(detail: Column, card: Column) -> Column:
    """The page's own pictures if it has any, else the card's."""
    return F.when(F.size(detail) > 0, no_blanks(detail)).otherwise(no_blanks(F.array(card)))


def fabeo(payloads: DataFrame, as_of: Column) -> DataFrame:
    """A shop's product with live facts: the lot runs while the page says so; VAT is 25 unless told."""
    rows = parsed(payloads, "struct<item:struct<id:long,name:string,description:string,short_description:string,permalink:string,images:array<struct<src:string>>,prices:struct<currency_code:string>>,detail:struct<endUnix:long,status:string,startBid:long,currentBid:long,bidCount:int,reserveMet:boolean,feeValue:long,vatRate:double>>")
    ends = F.timestamp_seconds(x("endUnix")).cast("timestamp_ntz")
    return conform(
        rows, "fabeo", external_id=i("id"), auction_external_id=i("id"), title=F.coalesce(i("name"), F.lit("")), description=F.coalesce(i("description"), i("short_description")), status=status_at(ends, as_of, x("status") == "running"), ends_at=ends,
        min_bid=x("startBid"), current_bid=x("currentBid"), bid_count=F.coalesce(x("bidCount"), F.lit(0)), reserve_status=reserve(x("reserveMet"), F.lit(False)), fee_value=x("feeValue"), vat_rate=F.coalesce(x("vatRate"), F.lit(25.0)),
        currency=F.coalesce(i("prices.currency_code"), F.lit("SEK")), seller=F.lit("Fabeo"), source_url=i("permalink"), media=no_blanks(F.transform(i("images"), lambda p: p["src"])), raw=F.col("raw"))


def bukowskis(payloads: DataFrame, as_of: Column) -> DataFrame:
    """The low estimate stands for the least bid; lots without an auction code belong to the online auction."""
    rows = parsed(payloads, "struct<item:struct<lotId:string,auctionCode:string,title:string,href:string,endUnix:long,estimate:long,currentBid:long,currency:string,images:array<string>>,detail:struct<description:string>>")
    ends = F.timestamp_seconds(i("endUnix")).cast("timestamp_ntz")
    return conform(
        rows, "bukowskis", external_id=i("lotId"), auction_external_id=F.coalesce(F.nullif(i("auctionCode"), F.lit("")), F.lit("online")), title=i("title"), description=x("description"), status=status_at(ends, as_of), ends_at=ends,
        min_bid=i("estimate"), current_bid=i("currentBid"), vat_rate=F.lit(0.0), currency=F.coalesce(i("currency"), F.lit("SEK")), seller=F.lit("Bukowskis"), source_url=F.concat(F.lit("https://www.bukowskis.com"), i("href")),
        media=no_blanks(i("images")), raw=F.col("raw"))


def event_title(title: Column) -> Column:
    """The title of an event without the date in front, starting upper case; a title that is only a date stays."""
    bare = F.trim(F.regexp_replace(title, r"^\d{4}\s\d{2}\s\d{2}\s*", ""))
    return F.when(bare == "", title).otherwise(F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare))))


def bna(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Pages of lots under their event; ends are local times."""
    rows = parsed(payloads, "struct<item:struct<itemId:string,eventId:string,title:string,href:string,location:string,endsLocal:string,minBid:long,currentBid:long,vatRate:double,images:array<string>>>")
    ends = exact_local(i("endsLocal"))
    return conform(
        rows, "bna", external_id=i("itemId"), auction_external_id=i("eventId"), title=i("title"), location=i("location"), status=status_at(ends, as_of), ends_at=ends, min_bid=i("minBid"), current_bid=i("currentBid"), vat_rate=i("vatRate"),
        seller=F.lit("BNA"), source_url=F.concat(F.lit("https://bna.nu"), i("href")), media=no_blanks(i("images")), raw=F.col("raw"))


def blinto(payloads: DataFrame, as_of: Column) -> DataFrame:
    """An exact end goes before the card's date without a year; the kind of thing opens the title unless it does
    already."""
    rows = parsed(payloads, "struct<item:struct<objId:string,href:string,type:string,title:string,location:string,endText:string,endsAtRaw:string,nextMinBid:long,bidCount:int,currentBid:long,image:string>,detail:struct<feeValue:long,vatRate:double,images:array<string>,description:string>>")
    ends = F.coalesce(exact_local(i("endsAtRaw")), yearless(i("endText"), as_of))
    kind = i("type")
    title = F.when((kind != "") & ~F.startswith(F.lower(i("title")), F.lower(kind)), F.concat_ws(" ", kind, i("title"))).otherwise(i("title"))
    return conform(
        rows, "blinto", external_id=i("objId"), auction_external_id=i("objId"), title=title, description=x("description"), location=i("location"), status=status_at(ends, as_of), ends_at=ends, min_bid=i("nextMinBid"), current_bid=i("currentBid"),
        bid_count=i("bidCount"), fee_value=x("feeValue"), vat_rate=F.coalesce(x("vatRate"), F.lit(25.0)), seller=F.lit("Blinto"), source_url=F.concat(F.lit("https://www.blinto.se"), i("href")), media=pictures(x("images"), i("image")), raw=F.col("raw"))


def kronofogden(payloads: DataFrame, as_of: Column) -> DataFrame:
    """The end follows from a countdown; nothing is added to the bid."""
    rows = parsed(payloads, "struct<item:struct<objId:string,inA:string,inO:string,title:string,location:string,startBid:long,currentBid:long,countdown:string,image:string>,detail:struct<description:string,images:array<string>>>")
    ends = as_of + F.make_dt_interval(secs=countdown_seconds(i("countdown")))
    return conform(
        rows, "kronofogden", external_id=i("objId"), auction_external_id=i("inA"), title=i("title"), description=x("description"), location=i("location"), status=status_at(ends, as_of), ends_at=ends, min_bid=i("startBid"), current_bid=i("currentBid"),
        fee_value=F.lit(0), vat_rate=F.lit(0.0), seller=F.lit("Kronofogden"), source_url=F.format_string("https://auktion.kronofogden.se/auk/w.object?inC=KFM&inA=%s&inO=%s", i("inA"), i("inO")), media=pictures(x("images"), i("image")), raw=F.col("raw"))


def siko(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Live answers hold the seconds that remain; a lot is open while there are some."""
    rows = parsed(payloads, "struct<item:struct<id:long,bid:long,secondsRemaining:long>,detail:struct<title:string,description:string,endsAt:string,images:array<string>>>")
    ends = F.coalesce(instant(x("endsAt")), as_of + F.make_dt_interval(secs=i("secondsRemaining")))
    return conform(
        rows, "siko", external_id=i("id"), auction_external_id=i("id"), title=F.coalesce(x("title"), F.concat(F.lit("Sikö "), i("id").cast("string"))), description=x("description"), status=F.when(i("secondsRemaining") > 0, "active").otherwise("ended"),
        ends_at=ends, current_bid=positive(i("bid")), vat_rate=F.lit(0.0), seller=F.lit("Sikö"), source_url=F.concat(F.lit("https://www.sikoauktioner.se/auktion/"), i("id").cast("string")), media=no_blanks(x("images")), raw=F.col("raw"))


def gak(payloads: DataFrame, as_of: Column, house: str = "gak") -> DataFrame:
    """Several houses on one platform. Dates name the month in full, without a year; the fee is a share of the bid plus
    a fixed part, known only with a bid and the terms of the page."""
    rows = parsed(payloads, "struct<item:struct<id:string,slug:string,title:string,endText:string,currentBid:long,image:string>,detail:struct<description:string,images:array<string>,fee:struct<purchaseFeePct:double,auctionFeeKr:double,itemVatRate:double>>>")
    ends = yearless(i("endText"), as_of)
    fee = F.when(i("currentBid") > 0, half_up(i("currentBid") * x("fee.purchaseFeePct") / 100 + x("fee.auctionFeeKr")))
    return conform(
        rows, house, external_id=i("id"), auction_external_id=i("id"), title=i("title"), description=x("description"), status=status_at(ends, as_of), ends_at=ends, current_bid=i("currentBid"), fee_value=fee,
        vat_rate=F.when(fee.isNotNull(), F.coalesce(x("fee.itemVatRate"), F.lit(0.0)) * 100), source_url=F.concat_ws("/", F.lit("auktion/objekt"), i("slug"), i("id")), media=pictures(x("images"), i("image")), raw=F.col("raw"))


def budi(payloads: DataFrame, as_of: Column) -> DataFrame:
    """The fee is a share of the bid with a floor, or fixed; it counts only where the VAT on the bid is known, and a
    VAT of nothing is known."""
    rows = parsed(payloads, "struct<item:struct<id:string,title:string,description:string,location:string,endsAt:string,ended:boolean,minBid:long,currentBid:long,bidCount:int,reserveMet:boolean,vatPercentage:double,sourceUrl:string,image:string,images:array<string>,feeParams:struct<dynBps:double,dynMinExVat:double,fixedExVat:double>>>")
    ends = instant(i("endsAt"))
    by_share = F.greatest(half_up(i("currentBid") * i("feeParams.dynBps") / 10000), i("feeParams.dynMinExVat"))
    fee = F.when((i("currentBid") > 0) & i("vatPercentage").isNotNull(), F.when(i("feeParams.dynBps") > 0, by_share).otherwise(i("feeParams.fixedExVat")))
    return conform(
        rows, "budi", external_id=i("id"), auction_external_id=i("id"), title=i("title"), description=i("description"), location=i("location"), status=status_at(ends, as_of, ~F.coalesce(i("ended"), F.lit(False))), ends_at=ends, min_bid=i("minBid"),
        current_bid=i("currentBid"), bid_count=i("bidCount"), reserve_status=reserve(i("reserveMet"), F.lit(False)), fee_value=fee, vat_rate=i("vatPercentage"), seller=F.lit("Budi Auktioner"), source_url=i("sourceUrl"),
        media=pictures(i("images"), i("image")), raw=F.col("raw"))


def _pieces(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """The stretches of a page that begin at ``pattern``, one row each."""
    return pages.select(F.explode(F.slice(F.split(html, pattern), 2, 1 << 30)).alias("p"))


def _field(pattern: str) -> Column:
    return F.nullif(strip_html(F.regexp_extract("p", pattern, 1)), F.lit(""))


def metropol(pages: DataFrame, as_of: Column, html: str = "html") -> DataFrame:
    """Cards of list pages. Only the lowest valid bid is told, so the current one is unknown."""
    at = METROPOL_CARD
    rows = _pieces(pages, html, at["start"])
    key = F.nullif(F.regexp_extract("p", at["link"], 2), F.lit(""))
    ends = exact_local(F.regexp_extract("p", at["end"], 1))
    return conform(
        rows, "metropol", external_id=key, auction_external_id=key, title=F.coalesce(_field(at["title"]), F.concat(F.lit("Metropol "), key)), description=_field(at["description"]), status=status_at(ends, as_of), ends_at=ends, min_bid=digits(_field(at["least"])),
        seller=F.lit("Metropol Auktioner"), source_url=F.concat(F.lit("https://www.metropol.se"), F.regexp_extract("p", at["link"], 1)), media=no_blanks(F.array(F.regexp_extract("p", at["image"], 1))), raw=F.to_json(F.struct("p")))


def pantbanken(pages: DataFrame, as_of: Column, html: str = "html") -> DataFrame:
    """Cards of list pages. What a card shows is the winning bid if somebody leads, else the starting price; who leads
    is not carried."""
    at = PANTBANKEN_CARD
    rows = _pieces(pages, html, at["start"])
    key = F.nullif(F.regexp_extract("p", at["key"], 1), F.lit(""))
    leader = F.trim(F.regexp_extract("p", at["leader"], 1))
    led = (leader != "") & (leader != "-")
    shown, start = digits(_field(at["bid"])), digits(_field(at["start_bid"]))
    count = F.coalesce(positive(digits(F.regexp_extract("p", at["bids"], 1))), F.lit(1))
    ends = exact_local(F.regexp_extract("p", at["end"], 1))
    return conform(
        rows, "pantbanken", external_id=key, auction_external_id=key, title=F.coalesce(_field(at["title"]), _field(at["alt"]), F.concat(F.lit("Pantbanken "), key)), status=status_at(ends, as_of), ends_at=ends, min_bid=F.when(led, start).otherwise(shown),
        current_bid=F.when(led, shown), bid_count=F.when(led, count).otherwise(0), seller=F.lit("Pantbanken Sverige"), source_url=F.concat(F.lit("https://www.pantbanken.se/auktioner/visa-auktionsvara/?f_id="), key),
        media=no_blanks(F.array(F.regexp_extract("p", at["image"], 1))), raw=F.to_json(F.struct("p")))


def lot_facts(html: Column) -> Column:
    """Lines 'label: value' of a lot's table of facts, without those that are fields of their own."""
    labels, values = (F.transform(F.regexp_extract_all(html, F.lit(LOT_FACT), F.lit(k)), strip_html) for k in (1, 2))
    pairs = F.filter(F.arrays_zip(labels.alias("k"), values.alias("v")), lambda p: (p["k"] != "") & (p["v"] != "") & ~p["k"].rlike(NO_FACT))
    return F.nullif(F.array_join(F.transform(pairs, lambda p: F.concat_ws(": ", p["k"], p["v"])), "\n"), F.lit(""))
