"""Mappers from recorded payloads (one JSON text per row in ``payload``) to the item contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import half_up, residual_vat, stepwise
from ..functions.text import digits, image_url, strip_html
from ..functions.times import exact_local, month_rule_utc
from ..rules.tables import BIDFLOW_PICTURE, FRIVIO_PICTURE, PAGE_DATA
from .contract import conform, reserve, status_at


def parsed(payloads: DataFrame, schema: str, col: str = "payload") -> DataFrame:
    """``d``: the payload under ``schema``, ``raw``: its text; payloads that are no JSON are dropped. A filter would read
    each payload twice, once for itself and once for the columns."""
    return payloads.select(F.explode(F.array_compact(F.array(F.from_json(col, schema)))).alias("d"), F.col(col).alias("raw"))


def exploded(payloads: DataFrame, schema: str, path: str = "") -> DataFrame:
    """One row per element of the list at ``path`` of a payload that is an object, or of a payload that is a list."""
    rows = parsed(payloads, schema)
    return rows.select(F.explode(F.col(f"d.{path}") if path else F.col("d")).alias("d")).withColumn("raw", F.to_json("d"))


def instant(text: Column) -> Column:
    """An ISO time, with or without zone, as UTC without zone."""
    return F.coalesce(F.try_to_timestamp(text), F.lit(None).cast("timestamp")).cast("timestamp_ntz")


def local_or_instant(text: Column) -> Column:
    """UTC of a time that names its zone, or of a local time that does not."""
    return F.when(text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), instant(text)).otherwise(exact_local(text))


def frivio(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Vehicles under the name of their brand. The source always says that no reserve was set, so none is known; a
    vehicle that is not active, or whose auction has an end state, is over. Pictures come as file names."""
    rows = exploded(payloads, "array<struct<id:long,title:string,region:string,city:string,brand:string,active:boolean,auction_end_state:string,starting_price:long,current_price:long,hammer_fee:int,auction_end:long,bid_count:int,photos:array<string>>>")
    d = lambda c: F.col(f"d.{c}")
    ends = F.timestamp_millis(d("auction_end")).cast("timestamp_ntz")
    address = lambda photo: F.when(F.startswith(photo, F.lit("http")), image_url(photo)).otherwise(F.concat(F.lit(FRIVIO_PICTURE), d("id").cast("string"), F.lit("/"), photo))
    named = F.contains(F.lower(d("title")), F.lower(d("brand")))
    title = F.when((d("brand") != "") & ~named, F.trim(F.concat_ws(" ", d("brand"), d("title")))).otherwise(d("title"))
    runs = F.coalesce(d("active"), F.lit(False)) & (F.coalesce(d("auction_end_state"), F.lit("")) == "")
    return conform(
        rows, "frivio", external_id=d("id"), auction_external_id=d("id"), title=title, location=F.coalesce(d("city"), d("region")), status=status_at(ends, as_of, runs), ends_at=ends, min_bid=d("starting_price"), current_bid=F.when(d("current_price") > 0, d("current_price")),
        bid_count=d("bid_count"), vat_rate=F.lit(0.0), seller=F.lit("Frivio"), source_url=F.concat(F.lit("https://frivio.se/auktion/"), d("id").cast("string")), media=F.transform(d("photos"), address), raw=F.col("raw"))


def junora(payloads: DataFrame, as_of: Column) -> DataFrame:
    """The fee follows from the reserve by steps; times are UTC without a mark."""
    rows = exploded(payloads, "struct<auctions:array<struct<remoteId:string,name:string,city:string,imageUrl:string,numBids:int,currentPrice:long,reservationPrice:double,reservationPriceMet:boolean,withoutReservationPrice:boolean,endTimeUtc:string,status:int>>>", "auctions")
    d = lambda c: F.col(f"d.{c}")
    ends = instant(F.regexp_replace(d("endTimeUtc"), "Z$", ""))
    return conform(
        rows, "junora", external_id=d("remoteId"), title=d("name"), location=d("city"), status=status_at(ends, as_of, d("status") == 2), ends_at=ends, current_bid=d("currentPrice"), bid_count=d("numBids"),
        reserve_status=reserve(d("reservationPriceMet"), d("withoutReservationPrice")), reserve_price=d("reservationPrice"), fee_value=stepwise(d("reservationPrice")), vat_rate=F.lit(0.0),
        media=F.array_compact(F.array(d("imageUrl"))), raw=F.col("raw"))


def retrade(payloads: DataFrame, as_of: Column) -> DataFrame:
    rows = exploded(payloads, "struct<auctions:array<struct<id:string,heading:string,highestBid:long,currency:string,image:string,place:string,auctionEnd:string,hasEnded:boolean,isSold:boolean>>>", "auctions")
    d = lambda c: F.col(f"d.{c}")
    ends = instant(d("auctionEnd"))
    over = F.coalesce(d("hasEnded"), F.lit(False)) | F.coalesce(d("isSold"), F.lit(False))
    return conform(rows, "retrade", external_id=d("id"), title=d("heading"), location=d("place"), status=status_at(ends, as_of, ~over), ends_at=ends, current_bid=F.nullif(d("highestBid"), F.lit(0)), currency=F.coalesce(d("currency"), F.lit("SEK")), media=F.array_compact(F.array(d("image"))), raw=F.col("raw"))


def flag(text: Column) -> Column:
    """A yes or no that comes as true, 1 or "1"; null if it is neither yes nor no."""
    return F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false", ""), False)


def netauktion(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Numbers come as texts, yes and no as numbers, times as local ones; VAT follows from the exact total of the top bid
    and is 25 while there is none. What a list card and the lot's page told may stand in the same record."""
    fields = "product_id:string,title:string,slug:string,location:string,description:string,images:array<string>,top_bid:string,top_bid_with_fee_and_tax:string,is_over_resprice:string,reserve_met:string,expiration_datetime:string,is_active:string,next_ok_bid:string,fee:double,bid_count:int"
    rows = exploded(payloads, f"array<struct<{fields}>>")
    d = lambda c: F.col(f"d.{c}")
    bid, total = d("top_bid").try_cast("double"), d("top_bid_with_fee_and_tax").try_cast("double")
    fee = F.coalesce(d("fee"), F.least(F.greatest(bid * 0.12, F.lit(100.0)), F.lit(50000.0)))
    ends = exact_local(d("expiration_datetime"))
    met = F.coalesce(flag(d("reserve_met")), flag(d("is_over_resprice")))
    return conform(
        rows, "netauktion", external_id=d("product_id"), title=d("title"), description=d("description"), location=d("location"), status=status_at(ends, as_of, flag(d("is_active"))), ends_at=ends, min_bid=d("next_ok_bid").try_cast("double"), current_bid=F.when(bid > 0, bid),
        bid_count=d("bid_count"), reserve_status=reserve(met, F.lit(False)), vat_rate=F.when((bid > 0) & total.isNotNull(), residual_vat(total, bid, fee)).otherwise(25), seller=F.lit("Netauktion"),
        source_url=F.when(d("slug").isNotNull(), F.concat(F.lit("https://www.netauktion.se/auktion/"), d("slug"), F.lit("?product="), d("product_id"))), media=F.array_compact("d.images"), raw=F.col("raw"))


def psauction(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Numbers come as texts with decimals, times as local ones, and 'active' and 'cancelled' as numbers where they come
    at all. VAT is that of the first bid told, or what the label of the bid says."""
    rows = parsed(payloads, "struct<id:long,title:string,highest:string,nextBid:string,active:string,cancelled:string,sold:boolean,reservationPriceReached:boolean,noReserve:boolean,currency:string,bidVatLabel:string,bids:array<struct<bid:string,vat:int>>,endingDate:string>")
    d = lambda c: F.col(f"d.{c}")
    ends = local_or_instant(d("endingDate"))
    top = F.array_max(F.transform(d("bids"), lambda b: whole_kronor(b["bid"])))
    open_ = F.coalesce(flag(d("active")), ~F.coalesce(d("sold"), F.lit(False))) & ~F.coalesce(flag(d("cancelled")), F.lit(False))
    label = F.when(d("bidVatLabel").rlike(r"(?i)inkl ej avlyftbar"), 0).when(d("bidVatLabel").rlike(r"\d\s*%"), 25)
    return conform(
        rows, "psauction", external_id=d("id"), auction_external_id=d("id"), title=d("title"), status=status_at(ends, as_of, open_), ends_at=ends, min_bid=digits(d("nextBid")), current_bid=F.coalesce(whole_kronor(d("highest")), top), bid_count=F.size(F.coalesce(d("bids"), F.array())),
        reserve_status=F.when(d("reservationPriceReached"), "met").when(F.coalesce(d("noReserve"), F.lit(False)), "none").otherwise("not_met"), vat_rate=F.coalesce(F.get(F.transform(d("bids"), lambda b: b["vat"]), F.lit(0)), label), currency=F.coalesce(d("currency"), F.lit("SEK")),
        seller=F.lit("PS Auction"), raw=F.col("raw"))


def whole_kronor(text: Column) -> Column:
    """The whole part of an amount such as '100.00'."""
    return F.floor(text.try_cast("decimal(18,2)")).cast("long")


def psauction_bids(payloads: DataFrame) -> DataFrame:
    """Bids of a lot under ids made of lot, time and value; who bid is left out."""
    rows = parsed(payloads, "struct<id:long,bids:array<struct<bid:string,date:string>>>").select(F.col("d.id").alias("item"), F.explode("d.bids").alias("b"))
    value = whole_kronor(F.col("b.bid"))
    return rows.select(F.concat_ws(":", "item", "b.date", value.cast("string")).alias("external_id"), F.col("item").cast("string").alias("item_external_id"), value.alias("value"), local_or_instant(F.col("b.date")).alias("created_at"))


def vaxxa(payloads: DataFrame, as_of: Column) -> DataFrame:
    """A search index answers results, hits and documents; times are in seconds. The lot's old id is its key if it has
    one; a price is the bid, and also the least one where the lot is for sale at once."""
    rows = exploded(payloads, "struct<results:array<struct<found:long,hits:array<struct<document:struct<id:string,old_id:string,title:string,price:long,listing_type:string,bids_count:int,end_time:long,is_reserve_met:boolean,image_url:string,category:string,subcategory:string,location_city:string,location_county:string>>>>>>", "results")
    hits = rows.select(F.explode("d.hits").alias("h")).select(F.col("h.document").alias("d")).withColumn("raw", F.to_json("d"))
    d = lambda c: F.col(f"d.{c}")
    ends = F.timestamp_seconds(d("end_time")).cast("timestamp_ntz")
    key = F.nullif(F.coalesce(d("old_id"), d("id")), F.lit(""))
    price = F.when(d("price") > 0, d("price"))
    return conform(
        hits, "vaxxa", external_id=key, auction_external_id=key, title=F.coalesce(d("title"), F.concat(F.lit("Vaxxa "), key)), location=F.coalesce(d("location_city"), d("location_county")), status=status_at(ends, as_of), ends_at=ends, min_bid=F.when(d("listing_type") == "BUY_NOW", price),
        current_bid=price, bid_count=F.coalesce(d("bids_count"), F.lit(0)), reserve_status=F.when(d("is_reserve_met"), "met").otherwise("not_met"), seller=F.lit("Vaxxa"), source_url=F.concat(F.lit("https://app.vaxxa.se/auctions/"), key), media=F.array_compact(F.array(d("image_url"))),
        raw=F.col("raw"))


def plus_free(key: Column) -> Column:
    return F.regexp_replace(key, r"^\+", "")


def in_swedish(names: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(F.try_element_at(names, F.lit("se")), F.try_element_at(names, F.lit("en")))), F.lit(""))


def bidflow_auctions(payloads: DataFrame) -> DataFrame:
    """Auctions of a catalogue, running and past: key, name, when their lots end, whether they run."""
    kind = "array<struct<Id:string,Date:string,Status:string,HeadInfo:struct<Head:map<string,string>>>>"
    rows = parsed(payloads, f"struct<ActiveAuctions:{kind},HistoryAuctions:{kind}>")
    every = rows.select(F.explode(F.concat(F.coalesce("d.ActiveAuctions", F.array()), F.coalesce("d.HistoryAuctions", F.array()))).alias("a"))
    key = plus_free(F.col("a.Id"))
    found = every.select(key.alias("auction"), F.coalesce(in_swedish(F.col("a.HeadInfo.Head")), F.concat(F.lit("Bidflow "), key)).alias("name"), local_or_instant(F.col("a.Date")).alias("ends"), (F.coalesce("a.Status", F.lit("")) != "Finished").alias("runs"))
    return found.filter("auction IS NOT NULL").dropDuplicates(["auction"])


def bidflow(payloads: DataFrame, as_of: Column, house: str = "bidflow", auctions: DataFrame | None = None, fee: tuple[float, float] | None = None) -> DataFrame:
    """Batches of result pages; names by language; ids may carry a plus sign and a lot's id joins auction and lot. A lot
    is over once its bidding has any result ('Sold', 'Unsold', or true). With ``auctions`` (from ``bidflow_auctions``)
    lots end with their auction, run while it does, and have the VAT that its name tells. ``fee`` is the slope and base
    of a calibrated fee, which holds all VAT."""
    lot = "struct<LotId:struct<AuctionId:string,LotId:string>,Name:map<string,string>,AuctionName:map<string,string>,BidStatus:struct<BiddingFinished:string,EndDate:string>,CurrentBid:long,ReservedPriceMet:boolean,ReservedPrice:long,Images:array<struct<Id:string,Version:string>>,LotLocation:struct<Address:struct<Address:string>>>"
    rows = exploded(payloads, f"array<struct<Query:string,Page:int,PageSize:int,Total:long,Result:array<{lot}>>>")
    lots = rows.select(F.explode("d.Result").alias("d")).withColumn("raw", F.to_json("d"))
    d = lambda c: F.col(f"d.{c}")
    lots = lots.withColumn("auction", plus_free(d("LotId.AuctionId")))
    ends, runs, vat = instant(d("BidStatus.EndDate")), F.lit(True), F.lit(None).cast("double")
    if auctions is not None:
        lots = lots.join(auctions, "auction", "left")
        ends, runs, vat = F.col("ends"), F.coalesce("runs", F.lit(True)), auction_vat(F.col("name"))
    result = F.lower(d("BidStatus.BiddingFinished"))
    bid = F.nullif(d("CurrentBid"), F.lit(0))
    line = F.when(bid > 0, half_up(bid * fee[0] + fee[1])) if fee else F.lit(None).cast("long")
    picture = lambda i: F.concat(F.lit(BIDFLOW_PICTURE[0]), F.coalesce(F.nullif(i["Version"], F.lit("")), F.lit(BIDFLOW_PICTURE[1])), F.lit(BIDFLOW_PICTURE[2]), i["Id"])
    return conform(
        lots, house, external_id=F.concat_ws("-", F.col("auction"), plus_free(d("LotId.LotId"))), auction_external_id=F.col("auction"), title=in_swedish(d("Name")), description=in_swedish(d("AuctionName")), location=d("LotLocation.Address.Address"),
        status=status_at(ends, as_of, runs & F.coalesce(result.isin("false", ""), F.lit(True))), ends_at=ends, current_bid=bid, reserve_status=reserve(d("ReservedPriceMet"), F.lit(False)), reserve_price=F.when(d("ReservedPrice") > 0, d("ReservedPrice")), fee_value=line,
        vat_rate=F.when(line.isNotNull(), 0.0).otherwise(vat), media=F.transform(F.filter(d("Images"), lambda i: F.coalesce(i["Id"], F.lit("")) != ""), picture), raw=F.col("raw"))


def auction_vat(name: Column) -> Column:
    """The VAT on bids that an auction's name tells: none, 25, or null if it does not say."""
    return F.when(name.rlike(r"(?i)moms\s*fri"), 0.0).when(name.rlike(r"(?i)\bmoms\b"), 25.0)


def typed_value(value: Column) -> Column:
    """The text of a document-store value, whichever of its kinds is set."""
    return F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in ("stringValue", "integerValue", "doubleValue", "booleanValue", "timestampValue")])


def upplands(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Auctions with their catalogue text; test auctions are out. ``origEndDate`` against ``endDate`` shows a soft close."""
    rows = exploded(payloads, "array<struct<auctionId:long,name:string,startDate:string,endDate:string,origEndDate:string,winnersGenerated:boolean,catalogText:string>>")
    d = lambda c: F.col(f"d.{c}")
    real = rows.filter(~F.coalesce(d("name").rlike(r"(?i)test"), F.lit(False)))
    ends = instant(d("endDate"))
    return conform(real, "upplands", external_id=d("auctionId"), auction_external_id=d("auctionId"), title=d("name"), description=strip_html(d("catalogText")), status=status_at(ends, as_of, ~F.coalesce(d("winnersGenerated"), F.lit(False))), ends_at=ends, raw=F.col("raw"))


def upplands_lots(pages: DataFrame, auctions: DataFrame, as_of: Column) -> DataFrame:
    """Lots from the data inside auctions' pages (html) and the auctions' terms (payload). A lot ends when it says, or
    with its auction; the fee is the auction's share of the bid with VAT plus its fixed part, and holds all VAT. Lots of
    test auctions keep their own facts but have no terms."""
    lot = "struct<id:long,auctionId:long,name:string,description:string,minBid:long,highBid:long,endDate:string,hasReserve:boolean,reserveMet:boolean,defaultImage:struct<images:array<struct<url:string>>>>"
    data = F.regexp_extract("html", PAGE_DATA, 1)
    rows = pages.select(F.from_json(data, f"struct<props:struct<pageProps:struct<inventoryItems:array<{lot}>>>>").alias("page")).select(F.explode("page.props.pageProps.inventoryItems").alias("d"))
    rows = rows.withColumns({"raw": F.to_json("d"), "auction": F.col("d.auctionId")})
    of = "struct<auctionId:long,name:string,endDate:string,winnersGenerated:boolean,buyersPremium:double,hammerFees:struct<buyer:struct<total:double>>>"
    listed = F.concat(*[F.coalesce(x, F.array()) for x in (F.from_json("payload", f"array<{of}>"), F.from_json("payload", f"struct<auctions:array<{of}>>")["auctions"])])  # the list itself, or under a name
    a = auctions.select(F.explode(F.filter(listed, lambda x: x["auctionId"].isNotNull() & ~F.coalesce(x["name"].rlike(r"(?i)test"), F.lit(False)))).alias("a"))
    a = a.select(F.col("a.auctionId").alias("auction"), instant(F.col("a.endDate")).alias("a_ends"), F.col("a.winnersGenerated").alias("won"), F.col("a.buyersPremium").alias("share"), F.col("a.hammerFees.buyer.total").alias("fixed")).dropDuplicates(["auction"])
    rows = rows.join(a, "auction", "left")
    d = lambda c: F.col(f"d.{c}")
    ends = F.coalesce(instant(d("endDate")), F.col("a_ends"))
    over = F.coalesce(F.col("won") & (F.col("a_ends") < as_of), F.lit(False))
    bid = F.when(d("highBid") > 0, d("highBid"))
    fee = F.when(F.col("share") > 0, half_up(bid * F.col("share") * 1.25 / 100 + F.coalesce(F.when(F.col("fixed") >= 0, F.col("fixed")), F.lit(0.0))))
    met = F.when(~F.coalesce(d("hasReserve"), F.lit(False)), "none").when(d("reserveMet"), "met").otherwise("not_met")
    return conform(
        rows, "upplands", external_id=d("id"), auction_external_id=F.col("auction"), title=F.coalesce(d("name"), F.concat(F.lit("Objekt "), d("id").cast("string"))), description=F.nullif(strip_html(d("description")), F.lit("")), status=status_at(ends, as_of, ~over), ends_at=ends,
        min_bid=F.when(d("minBid") > 0, d("minBid")), current_bid=bid, reserve_status=met, fee_value=fee, vat_rate=F.when(fee.isNotNull(), 0.0), seller=F.lit("Upplands Auktionsverk"), source_url=F.concat(F.lit("https://www.upplandsauktionsverk.se/sv-SE/auctions/"), F.col("auction").cast("string")),
        media=F.array_distinct(F.array_compact(F.transform(d("defaultImage.images"), lambda i: i["url"]))), raw=F.col("raw"))
