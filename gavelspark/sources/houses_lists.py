"""Mappers of sources that answer with structured records: lists of lots with their bids, flags and typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import half_up
from ..functions.text import slug
from .contract import conform, reserve, status_at
from .houses import exploded, instant

#: Years that an auction may lie ahead; what ends later has no real end.
FARTHEST_YEARS = 2
DEFAULT_STEP = 50
#: Categories whose goods carry no VAT on the bid (fixed values).
WITHOUT_VAT = ("fordon",)
_VALUE = "struct<stringValue:string,integerValue:string,doubleValue:double,booleanValue:boolean,timestampValue:string>"


def d(c: str) -> Column:
    return F.col(f"d.{c}")


def positive(*columns: Column) -> Column:
    """The first value that is over zero."""
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def no_blanks(urls: Column) -> Column:
    """Distinct addresses in order, without nulls and empty ones."""
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))


def real_time(text: Column) -> Column:
    """A local time as it is; all zeros and blanks are no time."""
    return F.when(~text.startswith("0000-00-00") & (text != ""), F.try_to_timestamp(text).cast("timestamp_ntz"))


def auctionet(payloads: DataFrame, as_of: Column, ended: bool = False) -> DataFrame:
    """The bid is the highest of the lot's own bids; a lot that is over was sold if it was hammered."""
    rows = exploded(
        payloads,
        "array<struct<id:long,auction_id:long,house:string,title:string,description:string,condition:string,location:string,ends_at:long,published_at:long,starting_bid_amount:long,bids:array<struct<amount:long>>,reserve_met:boolean,reserve_amount:long,currency:string,images:array<struct<hd:string,w640:string,mini:string,thumb:string>>,url:string,hammered:boolean>>",
    )
    ends = F.timestamp_seconds(F.nullif(d("ends_at"), F.lit(0))).cast("timestamp_ntz")
    over = F.lit(ended) | F.coalesce(ends <= as_of, F.lit(False))
    bids = F.coalesce(d("bids"), F.array().cast("array<struct<amount:bigint>>"))
    condition = F.when(d("condition") != "", F.concat(F.lit("Skick: "), d("condition")))
    return conform(
        rows, "auctionet", external_id=d("id"), auction_external_id=d("auction_id"), title=F.coalesce(d("title"), F.lit("")), description=F.nullif(F.concat_ws("\n\n", F.nullif(d("description"), F.lit("")), condition), F.lit("")),
        location=d("location"), status=F.when(~over, "active").when(F.coalesce(d("hammered"), F.lit(False)), "sold").otherwise("ended"), ends_at=ends, listed_at=F.timestamp_seconds(F.nullif(d("published_at"), F.lit(0))).cast("timestamp_ntz"),
        min_bid=d("starting_bid_amount"), current_bid=F.array_max(F.transform(bids, lambda b: b["amount"])), bid_count=F.size(bids), reserve_status=reserve(d("reserve_met"), F.lit(False)), reserve_price=d("reserve_amount"),
        currency=F.coalesce(d("currency"), F.lit("SEK")), seller=d("house"), source_url=F.coalesce(d("url"), F.concat(F.lit("https://auctionet.com/sv/"), d("id").cast("string"))),
        media=no_blanks(F.transform(d("images"), lambda i: F.coalesce(*[F.nullif(i[s], F.lit("")) for s in ("hd", "w640", "mini", "thumb")]))), raw=F.col("raw"))


def riksauktioner(payloads: DataFrame, as_of: Column, steps: DataFrame | None = None) -> DataFrame:
    """The least bid is the step of the lot's category (``steps``: category, bid_step), 50 where it is not known; facts
    come as key and value pairs."""
    image = "struct<url:string,sizes:map<string,string>>"
    rows = exploded(
        payloads,
        f"array<struct<id:long,auction:long,title:string,description:string,category:string,status:string,auction_status:string,ending:string,added:string,leading_bid:long,num_bids_placed:int,no_tax:string,auction_meta:array<struct<key:string,value:string>>,embed:struct<thumbnail:{image},gallery:array<{image}>>>>",
    )
    step = F.lit(DEFAULT_STEP)
    if steps is not None:
        rows = rows.join(steps.select(F.col("category").alias("__category"), "bid_step"), d("category") == F.col("__category"), "left")
        step = F.coalesce("bid_step", F.lit(DEFAULT_STEP))
    url = lambda i: F.coalesce(F.nullif(F.try_element_at(i["sizes"], F.lit("1024x1024")), F.lit("")), F.nullif(F.try_element_at(i["sizes"], F.lit("1920")), F.lit("")), i["url"])
    gallery = F.transform(F.concat(F.array(d("embed.thumbnail")), F.coalesce(d("embed.gallery"), F.array().cast(f"array<{image}>"))), url)
    meta = lambda key: F.get(F.transform(F.filter(d("auction_meta"), lambda m: m["key"] == key), lambda m: m["value"]), F.lit(0))
    ends = instant(d("ending"))
    open_ = (d("status") == "available") & ~d("auction_status").eqNullSafe("ended")
    return conform(
        rows, "riksauktioner", external_id=d("id"), auction_external_id=d("auction"), title=F.coalesce(d("title"), F.lit("")), description=d("description"), location=meta("Adress"), status=status_at(ends, as_of, open_), ends_at=ends,
        listed_at=instant(d("added")), min_bid=step, current_bid=d("leading_bid"), bid_count=F.coalesce(d("num_bids_placed"), F.lit(0)), vat_rate=F.when(d("no_tax") == "YES", 0.0).otherwise(25.0), seller=F.lit("Riksauktioner"),
        source_url=F.concat(F.lit("https://riksauktioner.se/objekt/"), d("id").cast("string")), media=no_blanks(gallery), raw=F.col("raw"))


def klaravik(payloads: DataFrame, as_of: Column) -> DataFrame:
    """The least bid is the first positive of starting price, next bid and step; VAT goes by the top category."""
    rows = exploded(
        payloads,
        "array<struct<id:long,name:string,url:string,startDate:string,endDate:string,ended:boolean,currentBid:long,startingPrice:long,nextBidStep:long,bidStep:long,amountOfBids:int,reservePriceStatus:string,auctionFee:long,categoryNameLevel1:string,municipalityName:string,countyName:string,mainImage:struct<imageUrlThumb:string>>>",
    )
    ends = instant(d("endDate"))
    kinds = F.create_map(*[F.lit(x) for pair in (("REACHED", "met"), ("NOTREACHED", "not_met"), ("NONE", "none")) for x in pair])
    vat = F.when(F.lower(F.coalesce(d("categoryNameLevel1"), F.lit(""))).isin(*WITHOUT_VAT), 0.0).otherwise(25.0)
    return conform(
        rows, "klaravik", external_id=d("id"), auction_external_id=d("id"), title=F.coalesce(d("name"), F.lit("")), location=F.nullif(F.concat_ws(", ", F.nullif(d("municipalityName"), F.lit("")), F.nullif(d("countyName"), F.lit(""))), F.lit("")),
        status=status_at(ends, as_of, ~F.coalesce(d("ended"), F.lit(False))), ends_at=ends, listed_at=instant(d("startDate")), min_bid=positive(d("startingPrice"), d("nextBidStep"), d("bidStep")), current_bid=positive(d("currentBid")),
        bid_count=F.coalesce(d("amountOfBids"), F.lit(0)), reserve_status=kinds[d("reservePriceStatus")], fee_value=d("auctionFee"), vat_rate=vat, seller=F.lit("Klaravik"), media=F.array_compact(F.array(d("mainImage.imageUrlThumb"))),
        source_url=F.coalesce(d("url"), F.format_string("https://www.klaravik.se/auktion/produkt/%s/", d("id"))), raw=F.col("raw"))


def tovek(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Lots of decoded row streams; fee and VAT are the source's own. A lot with its end behind it is over."""
    rows = exploded(
        payloads,
        "array<struct<itemId:long,itemPartId:long,itemAuctionId:long,itemTitle:string,itemDescription:string,itemLocation:array<string>,itemStatus:string,itemEndTime:string,itemMinBid:long,itemWinningBidValue:long,itemFeeValue:long,itemVatValue:double,media:array<struct<type:string,url:string,sort:int>>,images:array<string>>>",
    )
    ends = real_time(d("itemEndTime"))
    told = F.coalesce(d("itemStatus"), F.lit("unknown"))
    sorted_media = F.transform(F.array_sort(F.transform(d("media"), lambda m: F.struct(m["sort"].alias("sort"), m["url"].alias("url")))), lambda m: m["url"])
    return conform(
        rows, "tovek", external_id=d("itemId"), auction_external_id=d("itemAuctionId"), title=F.coalesce(d("itemTitle"), F.lit("")), description=d("itemDescription"), location=F.get(d("itemLocation"), F.lit(0)),
        status=F.when((told == "active") & F.coalesce(ends <= as_of, F.lit(False)), "ended").otherwise(told), ends_at=ends, min_bid=d("itemMinBid"), current_bid=d("itemWinningBidValue"), fee_value=d("itemFeeValue"), vat_rate=d("itemVatValue"),
        seller=F.lit("Tovek"), source_url=F.concat_ws("/", F.lit("https://tovek.se/auktion/rop"), F.coalesce(F.nullif(slug(d("itemTitle")), F.lit("")), F.lit("objekt")), d("itemId").cast("string")),
        media=F.when(F.size(d("media")) > 0, sorted_media).otherwise(F.coalesce(d("images"), F.array().cast("array<string>"))), raw=F.col("raw"))


_TRADERA = "array<struct<itemId:long,itemType:string,shortDescription:string,price:double,buyNowPrice:double,endDate:string,totalBids:int,reservedPriceReached:boolean,itemUrl:string,imageUrlTemplate:string,imageSecondaryUrlTemplate:string,categoryId:long>>"


def tradera(payloads: DataFrame, as_of: Column, sold: bool = False, image_format: str = "medium-fit") -> DataFrame:
    """Live or sold lots. A fixed price has no real end, and an end more than two years ahead is none either; lots that
    no price is known of are dropped. Who sells is never carried."""
    rows = exploded(payloads, _TRADERA)
    fixed = F.coalesce(d("itemType").isin("PureBin", "FixedPrice"), F.lit(False))
    price = F.coalesce(d("price"), d("buyNowPrice")) if sold else F.when(fixed, F.coalesce(positive(d("buyNowPrice")), d("price"))).otherwise(d("price"))
    rows = rows.withColumn("__price", price).filter("__price > 0")
    ends = instant(d("endDate"))
    if not sold:
        ends = F.when(~fixed & (ends < as_of + F.expr(f"INTERVAL {FARTHEST_YEARS * 365} DAYS")), ends)
    met = F.coalesce(d("reservedPriceReached"), F.lit(False))
    title = F.coalesce(F.nullif(F.trim(d("shortDescription")), F.lit("")), F.concat(F.lit("Tradera "), d("itemId").cast("string")))
    kept = F.struct("d.itemType", "d.categoryId", "d.totalBids")
    return conform(
        rows, "tradera", external_id=d("itemId"), title=title, status=F.lit("ended") if sold else F.lit("active"), ends_at=ends, current_bid=half_up(F.col("__price")), bid_count=F.when(d("totalBids") > 0, d("totalBids")),
        reserve_status=F.when(met, "met").otherwise(F.lit("none") if sold else F.lit(None)), seller=F.lit("Tradera"), source_url=d("itemUrl"),
        media=F.transform(F.array_compact(F.array(d("imageUrlTemplate"), d("imageSecondaryUrlTemplate"))), lambda u: F.replace(u, F.lit("{format}"), F.lit(image_format))), raw=F.to_json(kept))


def typed(value: Column) -> Column:
    """The text of a typed value, whichever of its kinds is set."""
    return F.coalesce(value["stringValue"], value["integerValue"], value["doubleValue"].cast("string"), value["booleanValue"].cast("string"), value["timestampValue"])


def auktiona(payloads: DataFrame, as_of: Column, auctions: DataFrame) -> DataFrame:
    """Documents of typed values. A price is a bid only where somebody leads; end and place come from the auction
    (``auctions``: auction_id, ends_at, city) where the lot has none. The fee is none, fixed, or a share of the bid."""
    value = _VALUE
    fields = f"title:{value},description:{value},auctionId:{value},currentPrice:{value},currentLeader:{value},url:{value},dateRange:struct<mapValue:struct<fields:struct<endDate:{value}>>>,pricing:struct<mapValue:struct<fields:struct<startPrice:{value}>>>,fee:struct<mapValue:struct<fields:struct<kind:{value},amount:{value}>>>,images:struct<arrayValue:struct<values:array<{value}>>>"
    rows = exploded(payloads, f"struct<documents:array<struct<name:string,fields:struct<{fields}>>>>", "documents")
    f = lambda c: typed(d(f"fields.{c}"))
    inner = lambda c, k: typed(d(f"fields.{c}.mapValue.fields.{k}"))
    rows = rows.withColumns({"__auction": f("auctionId"), "__price": f("currentPrice").try_cast("double"), "__led": F.coalesce(f("currentLeader") != "", F.lit(False))})
    parents = auctions.select(F.col("auction_id").cast("string").alias("__parent"), F.col("ends_at").alias("__ends"), F.col("city").alias("__city"))
    rows = rows.join(parents, F.col("__auction") == F.col("__parent"), "left")
    ends = F.coalesce(instant(inner("dateRange", "endDate")), F.col("__ends"))
    price = positive(F.col("__price"))
    bid = F.when(F.col("__led"), price)
    amount = inner("fee", "amount").try_cast("double")
    fee = F.when(inner("fee", "kind") == "fixed", amount).when(inner("fee", "kind") == "percentage", F.coalesce(price, F.lit(0.0)) * amount / 100).otherwise(0.0)
    key = F.element_at(F.split(d("name"), "/"), -1)
    return conform(
        rows, "auktiona", external_id=key, auction_external_id=F.col("__auction"), title=F.coalesce(f("title"), F.concat(F.lit("Auktiona "), key)), description=f("description"), location=F.col("__city"), status=status_at(ends, as_of), ends_at=ends,
        min_bid=F.when(~F.col("__led"), F.coalesce(price, positive(inner("pricing", "startPrice").try_cast("double")))), current_bid=bid, fee_value=half_up(fee), vat_rate=F.lit(0.0), seller=F.lit("Auktiona"),
        source_url=F.concat(F.lit("https://auktiona.se/auktioner"), F.coalesce(f("url"), F.concat(F.lit("/"), key))), media=no_blanks(F.transform(d("fields.images.arrayValue.values"), lambda v: v["stringValue"])), raw=F.col("raw"))


#: Where the result object of an escaped script begins.
_MARK = r'(?s)receiveSearchResults.*?result\\":(\{.*)'


def escaped_results(pages: DataFrame, html: str = "html") -> DataFrame:
    """(payload, total, capped, children) of search pages whose result object stands as an escaped string in a script:
    the lots as a payload for ``tradera``, how many there are, and the sub-categories below the chosen one. Pages
    without the mark give no row. The reader stops where the object closes, whatever follows it."""
    text = F.regexp_replace(F.regexp_extract(html, _MARK, 1), r'\\(["\\/])', "$1")
    node = "id:long,name:string,count:long,isSelected:boolean"
    tree = f"struct<{node},children:array<struct<{node},children:array<struct<{node},children:array<struct<{node}>>>>>>>"
    kinds = f"struct<totalItemCount:long,itemsMatchedWithCap:long,items:{_TRADERA},filters:array<struct<parameter:string,categoryTree:{tree}>>>"
    found = pages.filter(F.contains(html, F.lit("receiveSearchResults"))).select(F.from_json(text, kinds).alias("r")).filter("r IS NOT NULL")
    top = F.get(F.filter(F.col("r.filters"), lambda x: (x["parameter"] == "categoryId") & x["categoryTree"].isNotNull()), F.lit(0))["categoryTree"]
    chosen = lambda level: F.get(F.filter(level, lambda c: F.coalesce(c["isSelected"], F.lit(False))), F.lit(0))["children"]
    short = lambda level: F.transform(level, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["count"].alias("count")))
    first = top["children"]
    second = chosen(first)
    children = F.coalesce(short(chosen(second)), short(second), short(first))
    items = F.coalesce(F.col("r.items"), F.array().cast(_TRADERA))
    return found.select(F.to_json(items).alias("payload"), F.coalesce("r.totalItemCount", F.size(items)).cast("long").alias("total"), F.coalesce("r.itemsMatchedWithCap", F.lit(500)).alias("capped"), children.alias("children"))

