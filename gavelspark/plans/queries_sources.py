"""Queries over sources: every mapper on payloads made from the rows of a table, scrapes, the answers of services.

A payload holds the fields that its source would send, derived from a part's columns; the SQL states what the contract
must then hold, from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import houses, houses_cards as cards, houses_lists as lists, pages, pages_houses as readers
from .adapt import AS_OF, ntz, table
from .registry import ORACLE, query

c, lit = F.col, F.lit
MONTHS = "jan feb mar apr maj jun jul aug sep okt nov dec".split()
FULL = "januari februari mars april maj juni juli augusti september oktober november december".split()

_KEY = {"external_id": "p_partkey::VARCHAR", "title": "p_name"}
_ENDS = f"(TIMESTAMP '{AS_OF}' + to_hours(p_size - 25))"
_LOCAL = f"({_ENDS} - CASE WHEN month({_ENDS}) BETWEEN 4 AND 10 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END)"
_LIVE = "CASE WHEN p_size > 25 THEN 'active' ELSE 'ended' END"
_LOCAL_LIVE = "CASE WHEN p_size > 27 THEN 'active' ELSE 'ended' END"
_RESERVE = "CASE p_size % 3 WHEN 1 THEN 'met' WHEN 2 THEN 'not_met' END"
_PRICE = "floor(p_retailprice)::BIGINT"
_BID = "CASE WHEN p_size % 4 > 0 THEN p_size * 100 END::BIGINT"


#: Lots whose payloads or pages are made and read by one task.
LOTS_A_TASK = 25_000


def parts_of(spark: SparkSession, sf_dir: str, sheet: Column | None = None) -> DataFrame:
    """The parts, dealt over all cores: making and reading payloads and pages costs far more than the table itself. The
    number of tasks follows that of the parts, so that no task grows with the table. With ``sheet``, the parts of a sheet
    lie together: small rows travel, not the pages made of them, and adaptive execution does not put the tasks together."""
    parts = table(spark, sf_dir, "part")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-parts.count() // LOTS_A_TASK))
    return parts.repartition(tasks) if sheet is None else parts.withColumn("sheet", sheet).repartition(tasks, "sheet")


class Part:
    """Columns of a part that payloads are made of; made per run, as columns need a session."""

    def __init__(self) -> None:
        self.size, self.key = c("p_size"), c("p_partkey")
        self.ends = ntz(AS_OF) + F.make_dt_interval(hours=self.size - 25)
        self.iso = F.date_format(self.ends, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        self.seconds = F.unix_seconds(self.ends.cast("timestamp"))
        self.met = F.when(self.size % 3 == 1, True).when(self.size % 3 == 2, False)
        self.price = F.floor("p_retailprice")
        self.even = self.size % 2 == 0
        self.bid = F.when(self.size % 4 > 0, self.size * 100)

    def dated(self, months: list[str]) -> Column:
        """A day and month of the given names at nine o'clock, without a year."""
        month = F.element_at(F.array(*[lit(m) for m in months]), (self.key % 12 + 1).cast("int"))
        return F.concat(lit("Mån "), self.size % 28 + 1, lit(" "), month, lit(" 9:00"))


def some(condition: Column, value) -> Column:
    return F.when(condition, value if isinstance(value, Column) else lit(value))


def record(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def mapped(name: str, mapper: Callable[..., DataFrame], payload: Callable[[Part], Column], sql: dict[str, str], as_json: bool = True) -> None:
    """Registers ``map_<name>``: the payload of each part through the mapper; ``sql`` tells the columns to compare."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = payload(Part())
        rows = parts_of(spark, sf_dir).select((F.to_json(made) if as_json else made).alias("payload"))
        return mapper(rows, ntz(AS_OF)).withColumn("pictures", F.array_join("media", ",")).select(*sql)

    query(f"map_{name}", "SELECT " + ", ".join(f"{e} AS {x}" for x, e in sql.items()) + " FROM part")(run)




mapped(
    "auctionet", lists.auctionet,
    lambda p: F.array(record(
        id=p.key, auction_id=p.size, house=c("p_brand"), title=c("p_name"), description=c("p_type"), condition=some(p.even, "fin"), ends_at=p.seconds, starting_bid_amount=p.price, reserve_met=p.met, hammered=p.size % 3 == 0,
        bids=F.transform(F.filter(F.array(lit(2), lit(1), lit(3)), lambda k: k <= p.size % 4), lambda k: F.struct((p.key + 10 * k).alias("amount"))))),
    _KEY | {
        "description": "p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Skick: fin' ELSE '' END", "status": "CASE WHEN p_size > 25 THEN 'active' WHEN p_size % 3 = 0 THEN 'sold' ELSE 'ended' END", "ends_at": _ENDS,
        "current_bid": "CASE WHEN p_size % 4 > 0 THEN p_partkey + 10 * (p_size % 4) END", "bid_count": "p_size % 4", "reserve_status": _RESERVE, "seller": "p_brand", "min_bid": _PRICE},
)
mapped(
    "riksauktioner", lambda rows, at: lists.riksauktioner(rows, at, rows.sparkSession.createDataFrame([("PROMO", 500)], "category string, bid_step long")),
    lambda p: F.array(record(
        id=p.key, auction=p.size, title=c("p_name"), category=c("p_type"), status=lit("available"), auction_status=some(p.size % 4 == 0, "ended"), ending=p.iso, no_tax=some(p.even, "YES"), auction_meta=F.array(record(key=lit("Kontakt"), value=lit("x")), record(key=lit("Adress"), value=c("p_brand"))),
        embed=record(thumbnail=record(sizes=record(**{"1024x1024": lit("a.jpg")})), gallery=F.array(record(url=lit("a.jpg")), record(url=some(p.size % 3 == 0, "b.jpg")))))),
    _KEY | {
        "status": "CASE WHEN p_size > 25 AND p_size % 4 > 0 THEN 'active' ELSE 'ended' END", "ends_at": _ENDS, "min_bid": "CASE WHEN p_type = 'PROMO' THEN 500 ELSE 50 END::BIGINT", "vat_rate": "CASE WHEN p_size % 2 = 0 THEN 0 ELSE 25 END::DOUBLE",
        "location": "p_brand", "bid_count": "0", "pictures": "CASE WHEN p_size % 3 = 0 THEN 'a.jpg,b.jpg' ELSE 'a.jpg' END"},
)
mapped(
    "klaravik", lists.klaravik,
    lambda p: F.array(record(
        id=p.key, name=c("p_name"), endDate=p.iso, ended=p.size % 5 == 0, currentBid=F.coalesce(p.bid, lit(0)), startingPrice=F.when(p.even, p.price).otherwise(0), nextBidStep=F.when(p.size % 3 == 0, 200).otherwise(0), bidStep=lit(100), amountOfBids=p.size % 4,
        reservePriceStatus=F.when(p.size % 3 == 0, "NONE").when(p.size % 3 == 1, "REACHED").otherwise("NOTREACHED"), auctionFee=p.size, categoryNameLevel1=F.when(c("p_type") == "ECONOMY", "Fordon").otherwise(c("p_type")), municipalityName=some(p.even, "Umeå"), countyName=c("p_brand"))),
    _KEY | {
        "status": "CASE WHEN p_size > 25 AND p_size % 5 > 0 THEN 'active' ELSE 'ended' END", "ends_at": _ENDS, "min_bid": f"CASE WHEN p_size % 2 = 0 THEN {_PRICE} WHEN p_size % 3 = 0 THEN 200 ELSE 100 END::BIGINT", "current_bid": _BID, "bid_count": "p_size % 4",
        "reserve_status": "CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'met' ELSE 'not_met' END", "fee_value": "p_size::BIGINT", "vat_rate": "CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 25 END::DOUBLE", "location": "CASE WHEN p_size % 2 = 0 THEN 'Umeå, ' ELSE '' END || p_brand"},
)
mapped(
    "tovek", lists.tovek,
    lambda p: F.array(record(
        itemId=p.key, itemAuctionId=p.size, itemTitle=c("p_name"), itemLocation=F.array("p_brand"), itemStatus=some(p.size % 7 > 0, "active"), itemEndTime=F.when(p.size % 5 > 0, F.date_format(p.ends, "yyyy-MM-dd HH:mm:ss")).otherwise("0000-00-00 00:00:00"), itemMinBid=p.price, itemFeeValue=p.size, itemVatValue=lit(25.0),
        media=some(p.even, F.array(record(url=lit("second"), sort=lit(2)), record(url=lit("first"), sort=lit(1)))), images=F.array(lit("only")))),
    _KEY | {
        "status": "CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size % 5 = 0 OR p_size > 25 THEN 'active' ELSE 'ended' END", "ends_at": f"CASE WHEN p_size % 5 > 0 THEN {_ENDS} END", "min_bid": _PRICE, "fee_value": "p_size::BIGINT", "vat_rate": "25::DOUBLE", "location": "p_brand",
        "source_url": "'https://tovek.se/auktion/rop/' || replace(p_name, ' ', '-') || '/' || p_partkey", "pictures": "CASE WHEN p_size % 2 = 0 THEN 'first,second' ELSE 'only' END"},
)

def _tradera_lot(p: Part) -> Column:
    return record(
    itemId=p.key, itemType=F.when(p.size % 3 == 0, "PureBin").otherwise("Auction"), shortDescription=some(p.size % 5 > 0, F.concat(lit(" "), "p_name")), price=F.when(p.size % 7 > 0, p.size * 10 + 0.5).otherwise(0.0), buyNowPrice=some(p.size % 3 == 0, p.size * 20), endDate=F.when(p.size == 50, "2010-01-01T00:00:00Z").otherwise(p.iso),
    totalBids=p.size % 4, reservedPriceReached=p.even, imageUrlTemplate=lit("https://i/{format}/1.jpg"), imageSecondaryUrlTemplate=some(p.even, "https://i/{format}/2.jpg"), categoryId=p.size)
_TITLED = {"external_id": "p_partkey::VARCHAR", "title": "CASE WHEN p_size % 5 > 0 THEN p_name ELSE 'Tradera ' || p_partkey END"}


def _tradera(name: str, sold: bool, sql: dict[str, str], kept: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parts_of(spark, sf_dir).select(F.to_json(F.array(_tradera_lot(Part()))).alias("payload"))
        return lists.tradera(rows, ntz(AS_OF), sold).withColumn("pictures", F.array_join("media", ",")).select(*sql)

    query(name, "SELECT " + ", ".join(f"{e} AS {x}" for x, e in sql.items()) + f" FROM part WHERE {kept}")(run)


_tradera(
    "map_tradera_live", False,
    _TITLED | {
        "status": "'active'", "ends_at": f"CASE WHEN p_size % 3 > 0 AND p_size < 50 THEN {_ENDS} END", "current_bid": "CASE WHEN p_size % 3 = 0 THEN p_size * 20 ELSE p_size * 10 + 1 END::BIGINT", "bid_count": "CASE WHEN p_size % 4 > 0 THEN p_size % 4 END",
        "reserve_status": "CASE WHEN p_size % 2 = 0 THEN 'met' END", "pictures": "'https://i/medium-fit/1.jpg' || CASE WHEN p_size % 2 = 0 THEN ',https://i/medium-fit/2.jpg' ELSE '' END"},
    "p_size % 3 = 0 AND p_size > 0 OR p_size % 7 > 0",
)
_tradera(
    "map_tradera_sold", True,
    _TITLED | {"status": "'ended'", "ends_at": f"CASE WHEN p_size = 50 THEN TIMESTAMP '2010-01-01' ELSE {_ENDS} END", "current_bid": "(p_size * 10 + 1)::BIGINT", "reserve_status": "CASE WHEN p_size % 2 = 0 THEN 'met' ELSE 'none' END"},
    "p_size % 7 > 0",
)


@query(
    "scrape_escaped_results",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 500 ELSE 1000 END::BIGINT AS total, p_partkey::VARCHAR AS external_id, 'a "quoted" \\ ' || p_name AS title,
  CASE WHEN p_size % 2 = 0 THEN '21:5' ELSE '11:7,12:2' END AS children FROM part""",
)
def scrape_escaped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose results stand as an escaped string inside a script, with text before and behind."""
    p = Part()
    leaf = lambda i, n, **more: record(id=lit(i), name=lit(f"c{i}"), count=lit(n), **more)
    tree = record(id=lit(0), children=F.array(leaf(11, 7, isSelected=p.even, children=some(p.even, F.array(record(id=lit(21), name=lit("c21"), count=lit(5))))), record(id=lit(12), name=lit("c12"), count=lit(2), isSelected=lit(False), children=lit(None).cast("array<struct<id:int,name:string,count:int>>"))))
    lot = record(itemId=p.key, shortDescription=F.concat(lit('a "quoted" \\ '), "p_name"), price=lit(5.0))
    result = record(totalItemCount=F.when(p.key % 2 == 0, 500).otherwise(1000), items=F.array(lot), filters=F.array(record(parameter=lit("categoryId"), categoryTree=tree)))
    escaped = F.regexp_replace(F.to_json(result), r'(["\\])', r"\\$1")
    page = F.concat(lit('<html><script>push("receiveSearchResults",[1,"a:{\\"result\\":'), escaped, lit(',\\"more\\":{\\"x\\":1}}"])</script></html>'))
    pages = parts_of(spark, sf_dir).select(page.alias("html")).union(spark.createDataFrame([("<html>blocked</html>",)], "html string"))
    found = lists.escaped_results(pages)
    told = found.select("payload", "total", F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["id"].cast("string"), x["count"].cast("string"))), ",").alias("children"))
    lots = lists.tradera(found.select("payload"), ntz(AS_OF)).select("external_id", "title")
    keyed = told.withColumn("external_id", F.get_json_object("payload", "$[0].itemId"))
    return keyed.join(lots, "external_id").select("total", "external_id", "title", "children")


def _value(column: Column, kind: str = "stringValue") -> Column:
    return record(**{kind: column})


@query(
    "map_auktiona",
    f"""SELECT 'lot' || p_partkey AS external_id, p_name AS title, CASE WHEN p_size % 5 > 0 THEN s_name END AS location, CASE WHEN p_size > 25 OR p_size % 2 = 1 THEN 'active' ELSE 'ended' END AS status,
  CASE WHEN p_size % 2 = 0 THEN {_ENDS} WHEN s_suppkey IS NOT NULL THEN TIMESTAMP '2001-07-01' END AS ends_at, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 4 > 0 THEN p_size * 100 ELSE 50 END::BIGINT AS min_bid,
  CASE WHEN p_size % 3 = 0 AND p_size % 4 > 0 THEN p_size * 100 END::BIGINT AS current_bid, CASE p_size % 3 WHEN 0 THEN 30 WHEN 1 THEN floor(CASE WHEN p_size % 4 > 0 THEN p_size * 100 ELSE 0 END * 0.1 + 0.5) ELSE 0 END::BIGINT AS fee_value
  FROM part LEFT JOIN supplier ON s_suppkey = p_size AND p_size % 5 > 0""",
)
def map_auktiona(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    fields = record(
        title=_value(c("p_name")), auctionId=_value(p.size.cast("string"), "integerValue"), currentPrice=_value(F.coalesce(p.bid, lit(0)).cast("double"), "doubleValue"), currentLeader=_value(F.when(p.size % 3 == 0, "somebody").otherwise("")),
        dateRange=record(mapValue=record(fields=record(endDate=some(p.even, _value(p.iso, "timestampValue"))))), pricing=record(mapValue=record(fields=record(startPrice=_value(lit("50"), "integerValue")))),
        fee=some(p.size % 3 < 2, record(mapValue=record(fields=record(kind=_value(F.when(p.size % 3 == 0, "fixed").otherwise("percentage")), amount=_value(F.when(p.size % 3 == 0, "30").otherwise("10"), "integerValue"))))))
    docs = parts_of(spark, sf_dir).select(F.to_json(record(documents=F.array(record(name=F.concat(lit("projects/x/lots/lot"), p.key), fields=fields)))).alias("payload"))
    auctions = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 > 0").select(c("s_suppkey").alias("auction_id"), ntz("2001-07-01 00:00:00").alias("ends_at"), c("s_name").alias("city"))
    return lists.auktiona(docs, ntz(AS_OF), auctions).select("external_id", "title", "location", "status", "ends_at", "min_bid", "current_bid", "fee_value")


mapped(
    "fabeo", cards.fabeo,
    lambda p: record(item=record(id=p.key, name=c("p_name"), short_description=c("p_type"), images=F.array(record(src=lit("a")), record(src=lit("a")), record(src=lit("")))), detail=some(p.size % 7 > 0, record(endUnix=p.seconds, status=F.when(p.size % 5 > 0, "running").otherwise("closed"), startBid=p.price, currentBid=p.bid, bidCount=p.size % 4, reserveMet=p.met, feeValue=p.size, vatRate=some(p.even, 0.0)))),
    _KEY | {
        "description": "p_type", "status": "CASE WHEN p_size > 25 AND p_size % 5 > 0 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END", "ends_at": f"CASE WHEN p_size % 7 > 0 THEN {_ENDS} END", "current_bid": f"CASE WHEN p_size % 7 > 0 THEN {_BID} END",
        "bid_count": "CASE WHEN p_size % 7 > 0 THEN p_size % 4 ELSE 0 END", "reserve_status": f"CASE WHEN p_size % 7 > 0 THEN {_RESERVE} END", "fee_value": "CASE WHEN p_size % 7 > 0 THEN p_size END::BIGINT", "vat_rate": "CASE WHEN p_size % 7 > 0 AND p_size % 2 = 0 THEN 0 ELSE 25 END::DOUBLE", "pictures": "'a'"},
)
mapped(
    "bukowskis", cards.bukowskis,
    lambda p: record(item=record(lotId=p.key.cast("string"), auctionCode=F.when(p.even, "E1").otherwise(""), title=c("p_name"), href=lit("/x"), endUnix=some(p.size % 5 > 0, p.seconds), estimate=p.price, currentBid=p.bid, currency=some(p.size % 3 == 0, "EUR"))),
    _KEY | {"auction_external_id": "CASE WHEN p_size % 2 = 0 THEN 'E1' ELSE 'online' END", "status": "CASE WHEN p_size > 25 OR p_size % 5 = 0 THEN 'active' ELSE 'ended' END", "ends_at": f"CASE WHEN p_size % 5 > 0 THEN {_ENDS} END", "min_bid": _PRICE, "current_bid": _BID, "vat_rate": "0::DOUBLE", "currency": "CASE WHEN p_size % 3 = 0 THEN 'EUR' ELSE 'SEK' END"},
)
mapped(
    "bna", cards.bna,
    lambda p: record(item=record(itemId=p.key.cast("string"), eventId=p.size.cast("string"), title=c("p_name"), href=lit("/x"), location=c("p_brand"), endsLocal=F.concat(lit("Slutar "), F.date_format(p.ends, "yyyy-MM-dd HH:mm")), minBid=p.price, currentBid=p.bid, vatRate=F.when(p.even, 25.0).otherwise(0.0))),
    _KEY | {"auction_external_id": "p_size::VARCHAR", "location": "p_brand", "status": _LOCAL_LIVE, "ends_at": _LOCAL, "min_bid": _PRICE, "current_bid": _BID, "vat_rate": "CASE WHEN p_size % 2 = 0 THEN 25 ELSE 0 END::DOUBLE"},
)


def _yearless(month: str, day: str) -> str:
    """SQL of a local time without a year at nine o'clock, as UTC, not more than a day before the first of June 2001."""
    at = lambda y: f"(make_timestamp({y}, {month}, {day}, 9, 0, 0) - CASE WHEN {month} BETWEEN 4 AND 10 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END)"
    return f"CASE WHEN {at(2001)} < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN {at(2002)} ELSE {at(2001)} END"


_WHEN = _yearless("(p_partkey % 12 + 1)", "(p_size % 28 + 1)")
mapped(
    "blinto", cards.blinto,
    lambda p: record(item=record(objId=p.key.cast("string"), href=lit("/x"), type=F.when(p.size % 3 == 0, F.initcap(F.substring_index("p_name", " ", 1))).otherwise(c("p_type")), title=c("p_name"), endText=p.dated(MONTHS), endsAtRaw=some(p.even, F.date_format(p.ends, "yyyy-MM-dd HH:mm:ss")), nextMinBid=p.price, bidCount=p.size % 4, currentBid=p.size * 100, image=lit("card")),
           detail=some(p.size % 5 > 0, record(feeValue=p.size, vatRate=lit(0.0), images=F.array(lit("a"), lit("b"))))),
    {"external_id": "p_partkey::VARCHAR", "title": "CASE WHEN p_size % 3 = 0 OR starts_with(p_name, lower(p_type)) THEN p_name ELSE p_type || ' ' || p_name END", "ends_at": f"CASE WHEN p_size % 2 = 0 THEN {_LOCAL} ELSE {_WHEN} END", "status": f"CASE WHEN (CASE WHEN p_size % 2 = 0 THEN {_LOCAL} ELSE {_WHEN} END) > TIMESTAMP '{AS_OF}' THEN 'active' ELSE 'ended' END",
     "current_bid": _BID, "fee_value": "CASE WHEN p_size % 5 > 0 THEN p_size END::BIGINT", "vat_rate": "CASE WHEN p_size % 5 > 0 THEN 0 ELSE 25 END::DOUBLE", "pictures": "CASE WHEN p_size % 5 > 0 THEN 'a,b' ELSE 'card' END"},
)
mapped(
    "kronofogden", cards.kronofogden,
    lambda p: record(item=record(objId=p.key.cast("string"), inA=p.size.cast("string"), inO=lit("7"), title=c("p_name"), location=c("p_brand"), startBid=p.price, currentBid=p.bid, countdown=F.concat(p.size % 4, lit(" dygn "), p.size % 24, lit(" tim "), p.size % 60, lit(" minuter")))),
    _KEY | {"auction_external_id": "p_size::VARCHAR", "status": "CASE WHEN p_size = 0 THEN 'ended' ELSE 'active' END", "ends_at": f"TIMESTAMP '{AS_OF}' + to_days(p_size % 4) + to_hours(p_size % 24) + to_minutes(p_size % 60)", "current_bid": _BID, "fee_value": "0::BIGINT", "vat_rate": "0::DOUBLE", "source_url": "'https://auktion.kronofogden.se/auk/w.object?inC=KFM&inA=' || p_size || '&inO=7'"},
)
mapped(
    "siko", cards.siko,
    lambda p: record(item=record(id=p.key, bid=F.coalesce(p.bid, lit(0)), secondsRemaining=(p.size - 25) * 60), detail=some(p.size % 5 > 0, record(title=c("p_name"), endsAt=some(p.even, p.iso)))),
    {"external_id": "p_partkey::VARCHAR", "title": "CASE WHEN p_size % 5 > 0 THEN p_name ELSE 'Sikö ' || p_partkey END", "status": _LIVE, "ends_at": f"CASE WHEN p_size % 5 > 0 AND p_size % 2 = 0 THEN {_ENDS} ELSE TIMESTAMP '{AS_OF}' + to_minutes(p_size - 25) END", "current_bid": _BID},
)
mapped(
    "gak", cards.gak,
    lambda p: record(item=record(id=p.key.cast("string"), slug=lit("s"), title=c("p_name"), endText=p.dated(FULL), currentBid=p.bid), detail=some(p.size % 5 > 0, record(fee=record(purchaseFeePct=lit(12.5), auctionFeeKr=lit(30.0), itemVatRate=some(p.even, 0.25))))),
    _KEY | {"ends_at": _WHEN, "status": f"CASE WHEN {_WHEN} > TIMESTAMP '{AS_OF}' THEN 'active' ELSE 'ended' END", "current_bid": _BID, "fee_value": "CASE WHEN p_size % 5 > 0 AND p_size % 4 > 0 THEN floor(p_size * 12.5 + 30.5) END::BIGINT", "vat_rate": "CASE WHEN p_size % 5 > 0 AND p_size % 4 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 25 ELSE 0 END END::DOUBLE"},
)
mapped(
    "budi", cards.budi,
    lambda p: record(item=record(id=p.key.cast("string"), title=c("p_name"), endsAt=p.iso, ended=p.size % 5 == 0, minBid=p.price, currentBid=p.bid, bidCount=p.size % 4, reserveMet=p.met, vatPercentage=F.when(p.size % 3 == 0, 0.0).when(p.size % 3 == 1, 25.0), image=lit("card"), feeParams=record(dynBps=F.when(p.even, 1000.0).otherwise(0.0), dynMinExVat=lit(250.0), fixedExVat=lit(99.0)))),
    _KEY | {"status": "CASE WHEN p_size > 25 AND p_size % 5 > 0 THEN 'active' ELSE 'ended' END", "current_bid": _BID, "bid_count": "p_size % 4", "reserve_status": _RESERVE, "fee_value": "CASE WHEN p_size % 4 > 0 AND p_size % 3 < 2 THEN CASE WHEN p_size % 2 = 0 THEN greatest(p_size * 10, 250) ELSE 99 END END::BIGINT", "vat_rate": "CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 25 END::DOUBLE", "pictures": "'card'"},
)

def _metropol(p: Part) -> Column:
    return F.concat(
    lit('<div class="block-product-cards__card"><a href="/go/9/'), p.key, lit('"><img src="/i/1.jpg"></a><p class="c__name">'), "p_name", lit(' &amp; co</p><p class="c__description">'), "p_type", lit("<br>rest</p>Bjud mer än: <span>1 "), F.lpad(p.size.cast("string"), 3, "0"),
    lit(' kr</span><time datetime="'), F.date_format(p.ends, "yyyy-MM-dd'T'HH:mm"), lit('"></div>'))
mapped(
    "metropol", lambda rows, at: cards.metropol(rows, at, "payload"), lambda p: F.concat(lit("<html>list "), _metropol(p), lit('<div class="block-product-cards__card">no link</div></html>')),
    {"external_id": "p_partkey::VARCHAR", "title": "p_name || ' & co'", "description": "p_type || ' rest'", "status": _LOCAL_LIVE, "ends_at": _LOCAL, "min_bid": "(1000 + p_size)::BIGINT", "current_bid": "NULL::BIGINT", "source_url": "'https://www.metropol.se/go/9/' || p_partkey", "pictures": "'/i/1.jpg'"},
    as_json=False,
)


def _pant(p: Part) -> Column:
    return F.concat(
    lit('<div class="varubild"><a href="?f_id='), p.key, lit('"><img src="https://imagehandler/1.jpg" alt="bild"></a><h5><a class="vara" href="#">'), F.when(p.size % 5 > 0, c("p_name")).otherwise(""), lit('</a></h5><span class="aktuellt_bud current-bid">'), p.size, lit(' 00 kr</span><input name="start_bud" type="hidden" value="'), p.size * 2,
    lit('"><span class="bid-leader">'), F.when(p.even, "-").otherwise("anna"), lit('</span><span class="num-bids">'), F.when(p.size % 3 == 0, "").otherwise("4 bud"), lit('</span><span class="stanger">'), F.date_format(p.ends, "yyyy-MM-dd HH:mm:ss"), lit("</span></div>"))
mapped(
    "pantbanken", lambda rows, at: cards.pantbanken(rows, at, "payload"), lambda p: F.concat(lit("<html>top "), _pant(p), lit("</html>")),
    {"external_id": "p_partkey::VARCHAR", "title": "CASE WHEN p_size % 5 > 0 THEN p_name ELSE 'bild' END", "status": _LOCAL_LIVE, "ends_at": _LOCAL, "min_bid": "CASE WHEN p_size % 2 = 0 THEN p_size * 100 ELSE p_size * 2 END::BIGINT", "current_bid": "CASE WHEN p_size % 2 = 1 THEN p_size * 100 END::BIGINT", "bid_count": "CASE WHEN p_size % 2 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 1 ELSE 4 END"},
    as_json=False,
)
mapped(
    "frivio", houses.frivio,
    lambda p: F.array(record(id=p.key, title=F.when(p.even, c("p_name")).otherwise(F.concat(F.lower("p_brand"), lit(" "), "p_name")), brand=c("p_brand"), city=some(p.size % 3 > 0, "Malmö"), region=lit("Norr"), active=p.size % 5 > 0, auction_end_state=some(p.size % 7 == 0, "unsold"), starting_price=p.price, current_price=p.size * 100, reservations_pris=lit(False), hammer_fee=lit(5),
                             auction_end=p.seconds * 1000, bid_count=p.size % 4, photos=F.array(lit("https://x/a_thumb.jpg"), lit("b1.jpeg")))),
    {"external_id": "p_partkey::VARCHAR", "title": "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE lower(p_brand) END || ' ' || p_name", "location": "CASE WHEN p_size % 3 > 0 THEN 'Malmö' ELSE 'Norr' END", "status": "CASE WHEN p_size > 25 AND p_size % 5 > 0 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END", "ends_at": _ENDS, "min_bid": _PRICE, "current_bid": _BID,
     "reserve_status": "NULL::VARCHAR", "pictures": "'https://x/a.jpg,https://backend.frivio.se/vehicle/' || p_partkey || '/b1.jpeg'"},
)
mapped(
    "retrade", houses.retrade, lambda p: record(auctions=F.array(record(id=p.key.cast("string"), heading=c("p_name"), highestBid=F.coalesce(p.bid, lit(0)), place=c("p_brand"), auctionEnd=p.iso, hasEnded=p.size % 5 == 0, isSold=p.size % 7 == 0))),
    _KEY | {"location": "p_brand", "status": "CASE WHEN p_size > 25 AND p_size % 5 > 0 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END", "current_bid": _BID, "currency": "'SEK'"},
)
mapped(
    "netauktion", houses.netauktion,
    lambda p: F.array(record(product_id=p.key.cast("string"), title=c("p_name"), top_bid=(p.size * 100).cast("string"), top_bid_with_fee_and_tax=(p.size * F.when(p.even, 115).otherwise(160)).cast("string"), fee=p.size * 10.0, reserve_met=p.even, expiration_datetime=F.date_format(p.ends, "yyyy-MM-dd HH:mm:ss"), is_active=p.size % 5 > 0, next_ok_bid=(p.size * 100 + 100).cast("string"))),
    _KEY | {"status": "CASE WHEN p_size > 27 AND p_size % 5 > 0 THEN 'active' ELSE 'ended' END", "ends_at": _LOCAL, "min_bid": "(p_size * 100 + 100)::BIGINT", "current_bid": "nullif(p_size * 100, 0)::BIGINT", "reserve_status": "CASE WHEN p_size % 2 = 0 THEN 'met' ELSE 'not_met' END", "vat_rate": "CASE WHEN p_size % 2 = 1 THEN 25 ELSE 0 END::DOUBLE"},
)
mapped(
    "junora", houses.junora,
    lambda p: record(auctions=F.array(record(remoteId=p.key.cast("string"), name=c("p_name"), city=c("p_brand"), numBids=p.size % 4, currentPrice=p.size * 100, reservationPrice=lit(1000.0), reservationPriceMet=p.even, withoutReservationPrice=p.size % 5 == 0, endTimeUtc=F.date_format(p.ends, "yyyy-MM-dd'T'HH:mm:ss"), status=F.when(p.size % 7 > 0, 2).otherwise(3)))),
    _KEY | {"status": "CASE WHEN p_size > 25 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END", "ends_at": _ENDS, "current_bid": _BID, "reserve_status": "CASE WHEN p_size % 5 = 0 THEN 'none' WHEN p_size % 2 = 0 THEN 'met' ELSE 'not_met' END", "fee_value": "265::BIGINT"},
)
_PS_LOCAL = "p_size % 3 = 0"
mapped(
    "psauction", houses.psauction,
    lambda p: record(id=p.key, title=c("p_name"), highest=some(p.even, F.concat((p.size * 200).cast("string"), lit(".00"))), nextBid=F.concat(lit("1 "), F.lpad(p.size.cast("string"), 3, "0")), active=F.when(p.size % 5 > 0, 1).otherwise(0), cancelled=F.when(p.size % 7 > 0, 0).otherwise(1), sold=p.size % 5 == 0, reservationPriceReached=p.size % 3 == 1, noReserve=p.size % 3 == 2, currency=lit("SEK"),
                     bidVatLabel=F.when(p.even, "exkl 25% moms").otherwise("inkl ej avlyftbar moms"), bids=F.transform(F.filter(F.array(lit(2), lit(1), lit(3)), lambda k: k <= p.size % 4), lambda k: record(bid=F.concat((k * 100).cast("string"), lit(".00")), date=lit("2001-05-01 10:00"), vat=lit(12))),
                     endingDate=F.when(p.size % 3 == 0, F.date_format(p.ends, "yyyy-MM-dd HH:mm")).otherwise(p.iso)),
    _KEY | {"status": f"CASE WHEN p_size > CASE WHEN {_PS_LOCAL} THEN 27 ELSE 25 END AND p_size % 5 > 0 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END", "ends_at": f"CASE WHEN {_PS_LOCAL} THEN {_LOCAL} ELSE {_ENDS} END", "min_bid": "(1000 + p_size)::BIGINT", "bid_count": "p_size % 4",
            "current_bid": "CASE WHEN p_size % 4 > 0 THEN CASE WHEN p_size % 2 = 0 THEN p_size * 200 ELSE p_size % 4 * 100 END END::BIGINT", "reserve_status": "CASE p_size % 3 WHEN 1 THEN 'met' WHEN 2 THEN 'none' ELSE 'not_met' END", "vat_rate": "CASE WHEN p_size % 4 > 0 THEN 12 WHEN p_size % 2 = 0 THEN 25 ELSE 0 END::DOUBLE"},
)
mapped(
    "vaxxa", houses.vaxxa,
    lambda p: record(results=F.array(record(found=lit(1), hits=F.array(record(document=record(id=F.concat(lit("u"), p.key), old_id=some(p.size % 3 > 0, p.key.cast("string")), title=some(p.size % 6 > 0, c("p_name")), price=p.price, listing_type=F.when(p.even, "BUY_NOW").otherwise("AUCTION"), bids_count=p.size % 4, end_time=p.seconds, is_reserve_met=p.even,
                     image_url=lit("https://images.vaxxa.se/1.jpg"), location_city=some(p.size % 5 > 0, c("p_brand")), location_county=lit("Sjöbo"))))))),
    {"external_id": "CASE WHEN p_size % 3 > 0 THEN '' ELSE 'u' END || p_partkey", "title": "CASE WHEN p_size % 6 > 0 THEN p_name ELSE 'Vaxxa u' || p_partkey END", "location": "CASE WHEN p_size % 5 > 0 THEN p_brand ELSE 'Sjöbo' END", "status": _LIVE, "ends_at": _ENDS, "min_bid": f"CASE WHEN p_size % 2 = 0 THEN {_PRICE} END",
     "current_bid": f"CASE WHEN p_size % 4 > 0 THEN {_PRICE} END", "bid_count": "p_size % 4", "reserve_status": "CASE WHEN p_size % 2 = 0 THEN 'met' ELSE 'not_met' END", "pictures": "'https://images.vaxxa.se/1.jpg'"},
)


def _bidflow(p: Part) -> Column:
    result = F.when(p.size % 5 == 0, "Sold").when(p.size % 7 == 0, "Unsold")
    lot = record(
        LotId=record(AuctionId=F.concat(lit("+"), p.size), LotId=F.concat(lit("+"), p.key)), Name=record(se=some(p.even, c("p_name")), en=lit("english")), BidStatus=record(BiddingFinished=result), CurrentBid=F.coalesce(p.bid, lit(0)), ReservedPriceMet=p.met, ReservedPrice=some(p.even, p.size),
        Images=F.array(record(Id=lit("i"), Version=lit("v")), record(Id=lit("j"), Version=lit("")), record(Id=lit(""), Version=lit("v"))), LotLocation=record(Address=record(Address=c("p_brand"))))
    return F.array(record(Query=record(AuctionId=lit("+1"), Language=lit("se")), Page=lit(1), Total=lit(1), Result=F.array(lot)))


_BIDFLOW = {
    "external_id": "p_size || '-' || p_partkey", "auction_external_id": "p_size::VARCHAR", "title": "CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'english' END", "location": "p_brand", "status": "CASE WHEN p_size % 5 > 0 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END", "current_bid": _BID, "reserve_status": _RESERVE,
    "reserve_price": "CASE WHEN p_size % 2 = 0 THEN nullif(p_size, 0) END::BIGINT", "pictures": "'https://img.imageboss.me/v/width/1600/withoutEnlargement:true/i,https://img.imageboss.me/byraneffecta/width/1600/withoutEnlargement:true/j'",
}
mapped("bidflow", houses.bidflow, _bidflow, _BIDFLOW)


@query("bidflow_of_auctions", "SELECT " + ", ".join(f"{e} AS {x}" for x, e in {
    **{k: _BIDFLOW[k] for k in ("external_id", "current_bid")}, "status": "CASE WHEN p_size % 5 > 0 AND p_size % 7 > 0 AND (s_suppkey IS NULL OR (s_suppkey % 3 > 0 AND p_size > 25)) THEN 'active' ELSE 'ended' END", "ends_at": f"CASE WHEN s_suppkey IS NOT NULL THEN {_ENDS} END",
    "fee_value": "CASE WHEN p_size % 4 > 0 THEN floor(p_size * 100 * 0.25 + 30.5) END::BIGINT", "vat_rate": "CASE WHEN p_size % 4 > 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 0 WHEN s_suppkey % 2 = 1 THEN 25 END::DOUBLE"}.items()) + " FROM part LEFT JOIN supplier ON s_suppkey = p_size AND s_suppkey % 4 > 0")
def bidflow_of_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots under the auctions of a catalogue, one for each supplier, under a calibrated fee."""
    at = ntz(AS_OF) + F.make_dt_interval(hours=c("s_suppkey").cast("int") - 25)
    name = F.concat(lit("Marsauktion-"), F.when(c("s_suppkey") % 2 == 0, "Momsfri").otherwise("Moms"))
    auction = record(Id=F.concat(lit("+"), "s_suppkey"), Date=F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), Status=F.when(c("s_suppkey") % 3 == 0, "Finished").otherwise("Open"), HeadInfo=record(Head=record(en=lit(""), se=name)))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 > 0").groupBy(F.floor(c("s_suppkey") / 50)).agg(F.to_json(record(ActiveAuctions=F.collect_list(F.when(c("s_suppkey") % 3 > 0, auction)), HistoryAuctions=F.collect_list(F.when(c("s_suppkey") % 3 == 0, auction)))).alias("payload"))
    lots = parts_of(spark, sf_dir).select(F.to_json(_bidflow(Part())).alias("payload"))
    return houses.bidflow(lots, ntz(AS_OF), "sajab", houses.bidflow_auctions(known), (0.25, 30.0)).select("external_id", "current_bid", "status", "ends_at", "fee_value", "vat_rate")


mapped(
    "upplands", houses.upplands,
    lambda p: F.array(record(auctionId=p.key, name=F.concat(F.when(p.size % 6 == 0, "Bra ").otherwise(""), "p_name"), endDate=p.iso, winnersGenerated=p.size % 5 == 0, catalogText=F.concat(lit("<p>"), "p_type", lit(" &amp; mer</p>")))),
    {"external_id": "p_partkey::VARCHAR", "title": "CASE WHEN p_size % 6 = 0 THEN 'Bra ' ELSE '' END || p_name", "description": "p_type || ' & mer'", "status": "CASE WHEN p_size > 25 AND p_size % 5 > 0 THEN 'active' ELSE 'ended' END", "ends_at": _ENDS},
)


def _pages_of_gak(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """List pages of up to 44 lots, and the lots' own pages, built from the parts that ``map_gak`` takes as cards."""
    p = Part()
    bid = some(p.bid.isNotNull(), F.concat(lit('<span class="itemCurrentBid big"> '), F.regexp_replace(p.bid.cast("string"), r"(\d)(?=(\d{3})+$)", "$1 "), lit(" kr</span>")))
    card = F.concat(
        lit('<div class="item" data-item-id="'), p.key, lit('"><a href="/auktion/objekt/s/'), p.key, lit('"><img data-src="https://x.se/tn/small1/'), p.key, lit('.jpg"></a><meta name="title" content="'), p.key, lit(". "), "p_name",
        lit('"><div class="timeWrapper x"><span>'), p.dated(FULL), lit("</span></div>"), F.coalesce(bid, lit('<span class="itemCurrentBid">Inga bud</span>')), lit("</div>"))
    lists_ = _listed(parts_of(spark, sf_dir, F.floor(p.key / 44)), card, "<html><body><nav>x</nav>", "</body>")
    terms = F.concat(lit('<div class="priceInfo row" data-purchase-fee="12.5" data-auction-fee="30"'), F.when(p.even, ' data-item-vat="0.25"').otherwise(""), lit(">"))
    own = F.concat(lit('<p>x</p><div class="a itemDescription">Fin &amp; '), "p_type", lit("<br>hel</div><div>"), F.when(p.size % 5 > 0, terms).otherwise("<div>"), lit('<img itemprop="image" src="/AuctionItem/medium1.jpg"><img data-src="/AuctionItem/1.jpg"><img data-src="/AuctionItem/2.jpg">'))
    return lists_, parts_of(spark, sf_dir).select(p.key.alias("id"), own.alias("html"))


@query("pages_gak", f"SELECT g.*, 'Fin & ' || p_type || ' hel' AS description, '/AuctionItem/medium1.jpg,/AuctionItem/2.jpg' AS pictures FROM ({ORACLE['map_gak']}) g JOIN part ON p_partkey::VARCHAR = g.external_id")
def pages_gak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards.gak(pages.gak_payloads(*_pages_of_gak(spark, sf_dir)), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "ends_at", "status", "current_bid", "fee_value", "vat_rate", "description", "pictures")


@query("pages_siko", f"SELECT s.*, CASE WHEN p_size % 5 > 0 THEN p_type || ' av god kvalitet' END AS description FROM ({ORACLE['map_siko']}) s JOIN part ON p_partkey::VARCHAR = s.external_id")
def pages_siko(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    parts = parts_of(spark, sf_dir)
    local = p.ends + F.when(F.month(p.ends).between(4, 10), F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    clock = F.when(p.even, F.concat(lit('<span class="x countdown" title="'), F.date_format(local, "yyyy-MM-dd HH:mm:ss"), lit('"></span>'))).otherwise("")
    own = F.concat(lit("<title>"), "p_name", lit(" - Sikö Auktioner</title><p>Vi använder cookies på sidan</p>"), clock, lit("<p>kort</p><p><b>"), "p_type", lit("</b> av god kvalitet</p><p>En annan text som är lång nog</p>Utrop: 1 200 kr"))
    live = parts.select(p.key.cast("long").alias("id"), F.coalesce(p.bid, lit(0)).cast("long").alias("bid"), ((p.size - 25) * 60).cast("long").alias("secondsRemaining"))
    rows = cards.siko(pages.siko_payloads(live, parts.filter(p.size % 5 > 0).select(p.key.cast("long").alias("id"), own.alias("html"))), ntz(AS_OF))
    return rows.select("external_id", "title", "status", "ends_at", "current_bid", "description")


def _listed(parts: DataFrame, card: Column, before: str, after: str, name: str = "sheet") -> DataFrame:
    """The page of each sheet, its cards in the order of their keys, beside the sheet's number under ``name``."""
    drawn = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("card")))), lambda r: r["card"])
    return parts.groupBy(c("sheet").alias(name)).agg(F.concat(lit(before), F.array_join(drawn, "\n"), lit(after)).alias("html")).drop("sheet")


def _spaced(n: Column) -> Column:
    """A number with its thousands set apart."""
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{3})+$)", "$1 ")


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _local(p: Part) -> Column:
    """The local time that ``_LOCAL`` reads as UTC."""
    return F.date_format(p.ends, "yyyy-MM-dd HH:mm:ss")


_NET_SQL = f"""SELECT p_partkey::VARCHAR AS external_id, p_name || ' & co' AS title, CASE WHEN p_size % 3 > 0 THEN p_brand END AS location, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type || ' i gott skick' END AS description,
  CASE WHEN p_size > 27 AND (p_size % 7 = 0 OR p_size % 6 > 0) THEN 'active' ELSE 'ended' END AS status, {_LOCAL} AS ends_at, CASE WHEN p_size % 7 > 0 THEN p_size * 100 + 100 END::BIGINT AS min_bid, CASE WHEN p_size % 7 > 0 THEN {_BID} END AS current_bid,
  CASE WHEN p_size % 7 > 0 THEN p_size % 4 END::INT AS bid_count, CASE WHEN p_size % 7 > 0 THEN CASE WHEN p_size % 3 = 1 THEN 'met' ELSE 'not_met' END END AS reserve_status, CASE WHEN p_size % 7 > 0 AND p_size % 4 > 0 AND p_size % 2 = 0 THEN 0 ELSE 25 END::DOUBLE AS vat_rate,
  CASE WHEN p_size % 5 = 0 THEN 'https://www.netauktion.se/uploads/c' || p_partkey || '-l.jpg' ELSE 'https://www.netauktion.se/uploads/a' || p_partkey || '-l.jpg,https://www.netauktion.se/uploads/b-l.png' END AS pictures FROM part"""


def _net_bids(p: Part) -> Column:
    """A history of as many bids as ``bid_count`` says, the highest first."""
    row = lambda k: _joined('<li class="row"><div class="date"><span>2001-05-', F.lpad((k + 10).cast("string"), 2, "0"), ' Kl<br>21:3', k, '</span></div><div class="u-avatar" register_id="5"></div><div class="u-name"><span>Anna</span></div><div class="price"><b>', _spaced(p.size * (101 - k)), " SEK</b>", F.when(k == 2, '<span class="autobid">(autobud)</span>').otherwise(""), "</div></li>")
    return F.concat(lit("<h3 class='row'>Budhistorik</h3>"), F.array_join(F.transform(F.filter(F.array(lit(1), lit(2), lit(3)), lambda k: k <= p.size % 4), row), ""))


def _net_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on the lots' bids, some hundred lots an answer; a seventh of the lots is never answered."""
    p = Part()
    answer = record(
        product_id=p.key.cast("string"), top_bid=F.coalesce(p.bid, lit(0)).cast("string"), top_bid_with_fee_and_tax=F.floor(F.coalesce(p.bid, lit(0)) * F.when(p.even, 1.0).otherwise(1.25) + 1.25 * F.least(F.greatest(p.bid * 0.12, lit(100.0)), lit(50000.0))).cast("string"),
        top_bidder=lit("Anna"), is_over_resprice=F.when(p.met, 1).otherwise(0), reserve_met=p.met, expiration_datetime=_local(p), is_active=F.when(p.size % 6 > 0, 1).otherwise(0), next_ok_bid=(p.size * 100 + 100).cast("string"), bid_box=_net_bids(p))
    return parts_of(spark, sf_dir, F.floor(p.key / 100)).filter(p.size % 7 > 0).groupBy("sheet").agg(F.to_json(F.collect_list(answer)).alias("payload")).select("payload")


@query("pages_netauktion", _NET_SQL)
def pages_netauktion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages, answers on bids and the lots' own pages of one house, read and mapped."""
    p, parts = Part(), parts_of(spark, sf_dir)
    fact = lambda text: _joined('<div class="object-card-item-text"><b>', text, "</b></div>")
    card = _joined(
        "<article id='", p.key, "' class='x category-object-list'><a href='/auktion/en-sak?product=", p.key, "'><img src='/uploads/c", p.key, '-m.jpg\'></a><div class="object-card-title-text"> ', c("p_name"), " &amp; <i>co</i></div>",
        F.when(p.size % 3 > 0, fact(_joined("Lagringsort: ", c("p_brand")))).otherwise(""), fact(_joined("Avslutas: ", _local(p))), "</article>")
    own = _joined(
        '<div class="a object-description">', c("p_type"), " i <b>gott</b>\n skick</div><div>Liknande</div><div class='product-images my-simple-gallery-", p.key, "'><a href='/uploads/a", p.key, "-m.jpg' itemprop='contentUrl'></a><a itemprop='contentUrl' href='/uploads/b-m.png'></a><a href='/uploads/a", p.key,
        "-m.jpg' itemprop='contentUrl'></a></div><div class='my-simple-gallery-9999999'><a href='/uploads/z.jpg' itemprop='contentUrl'></a></div>")
    lists_ = _listed(parts_of(spark, sf_dir, F.floor(p.key / 40)), card, "<section><article id='n'>x</article>", "</section>")
    lots = parts.filter(p.size % 5 > 0).select(p.key.alias("id"), own.alias("html"))
    rows = houses.netauktion(readers.netauktion_payloads(lists_, _net_status(spark, sf_dir), lots), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "location", "description", "status", "ends_at", "min_bid", "current_bid", "bid_count", "reserve_status", "vat_rate", "pictures")


@query(
    "pages_netauktion_bids",
    """WITH k(k) AS (VALUES (1), (2), (3)) SELECT p_partkey || ':2001-05-' || (k + 10) || ' 21:3' || k || ':' || (p_size * (101 - k)) AS external_id, p_partkey::VARCHAR AS item_external_id, (p_size * (101 - k))::BIGINT AS value, CASE WHEN k = 2 THEN 'auto' ELSE 'normal' END AS type,
  make_timestamp(2001, 5, k + 10, 19, 30 + k, 0) AS created_at FROM part, k WHERE k <= p_size % 4 AND p_size % 7 > 0""",
)
def pages_netauktion_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.netauktion_bids(_net_status(spark, sf_dir))


def _fabeo_pages(parts: DataFrame) -> DataFrame:
    """The pages of products: the price and end of a related product come first."""
    p = Part()
    price = lambda n: _joined('<span class="woo-Price-amount amount">', _spaced(n), "&nbsp;kr</span>")
    row = lambda k: _joined('<tr class="bid" id="logid-', p.key * 10 + k, "\"><td class='date'>", k + 10, " maj 22:2", k, "</td><td class='bid'>", price(p.size * (101 - k)), "</td><td class='username'>", k, "</td></tr>")
    page = _joined(
        '<div class="auction-time-countdown" data-time="1" data-auctionid="-1"></div><span data-auction-id="-1" data-bid="5" data-status="ended"></span><p>', price(lit(77)), '</p><span class="auction-price" data-auction-id="', p.key, '" data-bid="', F.coalesce(p.bid, lit(0)), '" data-status="',
        F.when(p.size % 5 > 0, "running").otherwise("ended"), '">Nu ', price(F.coalesce(p.bid, p.price)), '</span><div class="x auction-time-countdown" data-time="', p.seconds, '" data-auctionid="', p.key, '"></div><p>Startbud: <b>', _spaced(p.price), " kr</b> Höjning per bud: 500 kr</p><p>En slagavgift på <b>", _spaced(p.size * 100),
        " kr</b> (exkl. moms) tillkommer.</p>", F.when(p.even, "<p>Objektet är momsfritt, momsfri försäljning</p>").otherwise("<p>12 % moms tillkommer på lagt bud</p>"), F.when(p.size % 3 == 0, "Inget reservationspris").when(p.size % 3 == 1, '<i class="reservation_yes"></i>').otherwise("Reservationspris ej uppnått"), "<a>Bud (", p.size % 4, ")</a><table>",
        F.array_join(F.transform(F.filter(F.array(lit(1), lit(2), lit(3)), lambda k: k <= p.size % 4), row), ""), "</table>")
    return parts.filter(p.size % 7 > 0).select(p.key.alias("id"), page.alias("html"))


@query("pages_fabeo", f"""SELECT p_partkey::VARCHAR AS external_id, p_name AS title, p_type AS description, CASE WHEN p_size > 25 AND p_size % 5 > 0 AND p_size % 7 > 0 THEN 'active' ELSE 'ended' END AS status, CASE WHEN p_size % 7 > 0 THEN {_ENDS} END AS ends_at, CASE WHEN p_size % 7 > 0 THEN {_PRICE} END AS min_bid,
  CASE WHEN p_size % 7 > 0 THEN {_BID} END AS current_bid, CASE WHEN p_size % 7 > 0 THEN p_size % 4 ELSE 0 END::INT AS bid_count, CASE WHEN p_size % 7 > 0 THEN {_RESERVE} END AS reserve_status, CASE WHEN p_size % 7 > 0 THEN p_size * 100 END::BIGINT AS fee_value,
  CASE WHEN p_size % 7 = 0 THEN 25 WHEN p_size % 2 = 0 THEN 0 ELSE 12 END::DOUBLE AS vat_rate FROM part""")  # fmt: skip
def pages_fabeo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop's catalogue and the pages of its products."""
    p, parts = Part(), parts_of(spark, sf_dir)
    products = parts.select(F.to_json(record(id=p.key, name=c("p_name"), short_description=c("p_type"))).alias("payload"))
    return cards.fabeo(readers.fabeo_payloads(products, _fabeo_pages(parts)), ntz(AS_OF)).select("external_id", "title", "description", "status", "ends_at", "min_bid", "current_bid", "bid_count", "reserve_status", "fee_value", "vat_rate")


@query("pages_fabeo_bids", "WITH k(k) AS (VALUES (1), (2), (3)) SELECT (p_partkey * 10 + k)::VARCHAR AS external_id, p_partkey::VARCHAR AS item_external_id, (p_size * (101 - k))::BIGINT AS value, 'normal' AS type, make_timestamp(2001, 5, k + 10, 20, 20 + k, 0) AS created_at FROM part, k WHERE k <= p_size % 4 AND p_size % 7 > 0")
def pages_fabeo_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.fabeo_bids(_fabeo_pages(parts_of(spark, sf_dir)), ntz(AS_OF))


_BUK_PICTURES = "'https://d1.cloudfront.net/' || p_partkey || '/1.jpg,https://d1.cloudfront.net/2.jpg'"


@query("pages_bukowskis", f"SELECT external_id, title, auction_external_id, status, ends_at, min_bid, current_bid, currency, CASE WHEN p_size % 5 > 0 THEN p_type || ' & olja' || chr(10) || 'Signerad.' END AS description, {_BUK_PICTURES} AS pictures FROM ({ORACLE['map_bukowskis']}) b JOIN part ON p_partkey::VARCHAR = external_id")
def pages_bukowskis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages and the lots' own pages of an art house."""
    p, parts = Part(), parts_of(spark, sf_dir)
    coin = F.when(p.size % 3 == 0, "EUR").otherwise("SEK")
    pictures = _joined("[&quot;https://d1.cloudfront.net/", p.key, "/1.jpg&quot;,&quot;https://d1.cloudfront.net/2.jpg&quot;]")
    card = _joined(
        "<div", F.when(p.size % 5 > 0, _joined(' data-end-date="', p.seconds, '"')).otherwise(""), ' data-lot-id="', p.key, '" data-images="', pictures, '"><a href="/sv/lots/page-2">x</a><a href="/sv/', F.when(p.even, "auctions/E1/").otherwise(""), "lots/", p.key, '-s"><img alt="', c("p_name"),
        '" src="https://d1.cloudfront.net/2.jpg"></a></div><p>', F.coalesce(_joined("<span>Aktuellt bud</span> <b>", _spaced(p.bid), "</b> ", coin), lit("Inga bud")), "</p><p>Utropspris ", _spaced(p.price), " ", coin, "</p>")
    own = _joined('<p>x</p><div class="c-lot-description"><p>', c("p_type"), " &amp; <i>olja</i></p><p> </p><p>Signerad.</p></div><p>y</p>")
    lots = parts.filter(p.size % 5 > 0).select(p.key.alias("id"), own.alias("html"))
    rows = cards.bukowskis(readers.bukowskis_payloads(_listed(parts_of(spark, sf_dir, F.floor(p.key / 40)), card, "<h1>1 588 föremål</h1>", "<footer>z</footer>"), lots), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "auction_external_id", "status", "ends_at", "min_bid", "current_bid", "currency", "description", "pictures")


@query("pages_bna", f"SELECT b.* REPLACE (p_type AS location), 'https://bna.nu/auktion/objekt/en-/-sak/' || external_id AS source_url, 'https://bna.nu/images/custom/AuctionItem/' || external_id || '.jpg,https://bna.nu/images/custom/AuctionItem/7' || external_id || '.jpg' AS pictures FROM ({ORACLE['map_bna']}) b JOIN part ON p_partkey::VARCHAR = external_id")
def pages_bna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of events, one for each size of a part, and of their lots."""
    p, parts = Part(), parts_of(spark, sf_dir)
    href = _joined("/auktion/objekt/en-/-sak/", p.key)
    card = _joined('<a href="', href, '">x</a><a href="/auktion/2001-06-01-annan/9">y</a><a href="', href, '">z</a>')
    own = _joined(
        "<h1>", p.key, ". <b>", c("p_name"), "</b></h1><h1>annat</h1>", F.coalesce(_joined("<p>Högsta bud: <b>", _spaced(p.bid), "</b> kr</p>"), lit("<p>Inga bud</p>")), "<p>Utrop: ", _spaced(p.price), " kr</p><p>Slutar ", F.date_format(p.ends, "yyyy-MM-dd HH:mm"), "</p>", F.when(p.even, "<p>Moms tillkommer med 25 % på budet</p>").otherwise("<p>Momsfritt</p>"),
        "<dl><dt>Ort:</dt><dd>", c("p_type"), '</dd></dl><img data-src="/images/custom/AuctionItem/tn/', p.key, '.jpg"><img src="/images/custom/AuctionItem/', p.key, '.jpg"><img src="/images/custom/AuctionItem/tn/7', p.key, '.jpg">')
    events = _listed(parts_of(spark, sf_dir, p.size), card, "<html>", "</html>", "event")
    rows = cards.bna(readers.bna_payloads(events, parts.select(href.alias("href"), own.alias("html"))), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "auction_external_id", "location", "status", "ends_at", "min_bid", "current_bid", "vat_rate", "source_url", "pictures")


@query("pages_blinto", f"""SELECT external_id, title, CASE WHEN p_size % 3 > 0 THEN p_brand END AS location, ends_at, status, CASE WHEN p_size % 2 = 0 THEN {_PRICE} END AS min_bid, current_bid, fee_value, CASE WHEN p_size % 5 > 0 AND p_size % 3 = 0 THEN 0 ELSE 25 END::DOUBLE AS vat_rate,
  CASE WHEN p_size % 5 > 0 THEN 'https://cdn.blinto.se/object/' || p_partkey || '/1.jpg/1200x900f,https://static.blinto.se/object/' || p_partkey || '_2.png' ELSE 'https://cdn.blinto.se/object/' || p_partkey || '/1.jpg/1200x900f' END AS pictures,
  CASE WHEN p_size % 5 > 0 THEN p_type || ' & mer' || chr(10) || chr(10) || '- Rad ett' || chr(10) || chr(10) || '- Rad två' END AS description FROM ({ORACLE['map_blinto']}) b JOIN part ON p_partkey::VARCHAR = external_id""")  # fmt: skip
def pages_blinto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages, both kinds of answers on bids, and the lots' own pages. Answers by lot come for every second lot,
    which then ends exactly when they say."""
    p, parts = Part(), parts_of(spark, sf_dir)
    kind = F.when(p.size % 3 == 0, F.initcap(F.substring_index("p_name", " ", 1))).otherwise(c("p_type"))
    auction = p.key + 500000
    card = _joined(
        '<a class="c" href="/auction/en-sak-', p.key, "-", auction, '/"><img data-src="https://cdn.blinto.se/object/', p.key, '/1.jpg/300x200f?x=1"><span class="brand-type">', kind, '</span><span class="h3-second-line b">', c("p_name"), "</span>",
        F.when(p.size % 3 > 0, _joined('<div class="card-location"><i class="icon"></i> ', c("p_brand"), "</div>")).otherwise(""), '<span id="time-left_', p.key, '">', p.dated(MONTHS), "</span><b>7 SEK</b><b>", p.size % 4, " bud</b></a>")
    live = parts.filter(p.even).select(_joined(auction, "|", p.size * 100, "|x|", _local(p), "|1|mån|y|tis||0|", p.price).alias("answer"))
    told = record(maxbid=_joined(_spaced(p.size * 100), " SEK"), numbid=_joined(p.size % 4, " bud"))
    counts = parts_of(spark, sf_dir, F.floor(p.key / 100)).groupBy("sheet").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(auction.cast("string"), told)))).alias("payload"))
    own = _joined(
        '<script>{"slagavgift på":"x","Momsfri försäljning":"y"}</script><p>En slagavgift på <b>', p.size, " SEK</b> (exkl. moms)</p>", F.when(p.size % 3 == 0, "<p>Momsfri försäljning</p>").otherwise("<p>25 % moms tillkommer på lagt bud</p>"), '<img src="https://cdn.blinto.se/object/', p.key,
        '/1.jpg/90x60f"><img src="https://cdn.blinto.se/object/x/9.jpg"><img src="https://static.blinto.se/object/', p.key, '_2.png"><img src="https://cdn.blinto.se/object/', p.key, "/1.jpg/1200x900f\"><div id='description-content'><p>", c("p_type"),
        " &amp;  mer</p><ul><li>Rad ett</li><li>Rad två</li></ul><p>Objektet säljs på uppdrag av en kund</p><p>slut</p></div><p>annat</p>")
    lots = parts.filter(p.size % 5 > 0).select(p.key.alias("id"), own.alias("html"))
    rows = cards.blinto(readers.blinto_payloads(_listed(parts_of(spark, sf_dir, F.floor(p.key / 40)), card, "<html>", "<p>fot 9 SEK</p></html>"), live, counts.select("payload"), lots), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "location", "ends_at", "status", "min_bid", "current_bid", "fee_value", "vat_rate", "pictures", "description")


_KFM = "https://pic1.auction2000.online/aukpic/kfm/"


@query("pages_kronofogden", f"""SELECT k.* REPLACE (CASE WHEN p_size % 4 > 0 THEN NULL ELSE {_PRICE} END AS min_bid), p_brand || ' väg 1' AS location, CASE WHEN p_size % 5 > 0 THEN p_type || chr(10) || 'Fin & hel.' || chr(10) || chr(10) || 'Varunr F1' END AS description,
  '{_KFM}' || p_size || '/' || p_partkey || '_1.jpg' || CASE WHEN p_size % 5 > 0 THEN ',{_KFM}' || p_size || '/' || p_partkey || '_2.jpg' ELSE '' END AS pictures
  FROM (SELECT *, NULL::BIGINT AS min_bid FROM ({ORACLE['map_kronofogden']})) k JOIN part ON p_partkey::VARCHAR = external_id""")  # fmt: skip
def pages_kronofogden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages with live facts and the lots' own pages of the enforcement authority."""
    p, parts = Part(), parts_of(spark, sf_dir)
    picture = lambda n, size: _joined(_KFM, p.size, "/", p.key, f"_{n}{size}.jpg")
    card = _joined(
        '<div id="', p.key, '" class="obj_thumbnail c"><a href="w.object?inC=KFM&amp;inA=', p.size, '&amp;inO=7"><span onmouseover="show(\'', picture(1, "_thumb"), "?5')\"></span></a><small class=\"text-muted\">före</small><div class=\"obj_txt c_obj_", p.key, '"><span class="text-muted">F1.</span> ', c("p_name"),
        '<br><small><span class="glyphicon glyphicon-map-marker"></span> ', c("p_brand"), ' väg 1</small><br><span class="nico28">9 SEK</span></div><div class="bid_txt_', p.key, '"><span>', F.when(p.bid.isNotNull(), "Högsta bud").otherwise("Startpris"), "</span> <b>", _spaced(F.coalesce(p.bid, p.price)), " SEK</b> <i>1 SEK</i></div><span id=\"time_txt_", p.key, '">',
        p.size % 4, " dygn ", p.size % 24, " tim ", p.size % 60, " minuter</span></div>")
    own = _joined(
        '<p>x</p><div style="margin-top: 20px;"><p>', c("p_type"), "<br>\nFin &amp; hel.<br><br>Varunr F1<br>Vi kan inte erbjuda frakt.<br>z</p></div><p>y</p><img src='", picture(1, "_mid"), "?1'><img src='", picture(2, ""), "'><img src='", _KFM, "1/9", p.key, "_1.jpg'>")
    lots = parts.filter(p.size % 5 > 0).select(p.key.alias("id"), own.alias("html"))
    rows = cards.kronofogden(readers.kronofogden_payloads(_listed(parts_of(spark, sf_dir, F.floor(p.key / 40)), card, "<html>", "</html>"), lots), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "auction_external_id", "status", "ends_at", "current_bid", "fee_value", "vat_rate", "source_url", "min_bid", "location", "description", "pictures")


@query("pages_upplands", f"""WITH a AS (SELECT s_suppkey, s_suppkey % 7 > 0 AS given, TIMESTAMP '{AS_OF}' + to_hours(s_suppkey::INT - 25) AS a_ends FROM supplier)
SELECT p_partkey::VARCHAR AS external_id, p_size::VARCHAR AS auction_external_id, p_name AS title, p_type || ' "hel" & ren' AS description, coalesce(CASE WHEN p_size % 3 > 0 THEN {_ENDS} END, CASE WHEN given THEN a_ends END) AS ends_at,
  CASE WHEN coalesce(coalesce(CASE WHEN p_size % 3 > 0 THEN {_ENDS} END, CASE WHEN given THEN a_ends END) > TIMESTAMP '{AS_OF}', true) THEN 'active' ELSE 'ended' END AS status, {_PRICE} AS min_bid, {_BID} AS current_bid,
  CASE WHEN p_size % 5 = 0 THEN 'none' WHEN p_size % 2 = 0 THEN 'met' ELSE 'not_met' END AS reserve_status, CASE WHEN given AND p_size % 4 > 0 THEN floor(p_size * 100 * 0.2 + 30.5) END::BIGINT AS fee_value, CASE WHEN given AND p_size % 4 > 0 THEN 0 END::DOUBLE AS vat_rate, 'u1,u2' AS pictures
FROM part LEFT JOIN a ON s_suppkey = p_size""")  # fmt: skip
def pages_upplands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of auctions, one for each size of a part, which hold their lots as data, under the terms of the
    auctions, one for each supplier. Every seventh is a test, whose terms do not count."""
    p, parts = Part(), parts_of(spark, sf_dir)
    lot = record(
        id=p.key, auctionId=p.size, name=c("p_name"), description=F.concat(lit('<p>'), "p_type", lit(' "hel" &amp; <b>ren</b></p>')), minBid=p.price, highBid=F.coalesce(p.bid, lit(0)), endDate=some(p.size % 3 > 0, p.iso), hasReserve=p.size % 5 > 0, reserveMet=p.even,
        defaultImage=record(images=F.array(*[record(url=lit(u)) for u in ("u1", "u2", "u1")])))
    data = F.to_json(record(props=record(pageProps=record(inventoryItems=F.collect_list(lot)))))
    pages_ = parts.groupBy(p.size).agg(_joined('<!DOCTYPE html><html><script>1</script><script id="__NEXT_DATA__" type="application/json">', data, "</script></html>").alias("html"))
    key = c("s_suppkey")
    ends = F.date_format(ntz(AS_OF) + F.make_dt_interval(hours=key.cast("int") - 25), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    terms = record(auctionId=key, name=F.concat(F.when(key % 7 > 0, "Auktion ").otherwise("Ett test "), key), endDate=ends, winnersGenerated=key % 2 == 0, buyersPremium=lit(16.0), hammerFees=record(buyer=record(total=lit(30.0))))
    auctions = table(spark, sf_dir, "supplier").groupBy(F.floor(key / 50)).agg(F.to_json(F.collect_list(terms)).alias("payload"))
    rows = houses.upplands_lots(pages_, auctions, ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "auction_external_id", "title", "description", "ends_at", "status", "min_bid", "current_bid", "reserve_status", "fee_value", "vat_rate", "pictures")


@query("pages_budi", f"""WITH b AS (SELECT *, p_size % 3 > 0 AS live, p_size % 4 AS n, 'https://media.budi.se/cdn-cgi/image/format=auto,quality=high,width=800/auctionobjects/images/k/' || p_partkey AS base FROM part)
SELECT p_partkey::VARCHAR AS external_id, p_name || ' & co' AS title, p_brand AS location, {_ENDS} AS ends_at, CASE WHEN p_size > 25 AND p_size % 5 > 0 AND (NOT live OR p_size % 7 > 0) THEN 'active' ELSE 'ended' END AS status, CASE WHEN n = 0 THEN CASE WHEN live THEN 4321 ELSE 1000 + p_size END END::BIGINT AS min_bid,
  CASE WHEN n > 0 THEN CASE WHEN live THEN p_size * 100 ELSE 1000 + p_size END END::BIGINT AS current_bid, n::INT AS bid_count, CASE WHEN live THEN CASE WHEN p_size % 2 = 0 THEN 'met' ELSE 'not_met' END END AS reserve_status,
  CASE WHEN n > 0 AND live AND p_size % 5 > 1 THEN CASE WHEN p_size % 2 = 0 THEN greatest(floor(p_size * 16 + 0.5), 300) ELSE 99 END END::BIGINT AS fee_value, CASE WHEN live THEN CASE WHEN p_size % 2 = 0 THEN 0 ELSE 25 END END::DOUBLE AS vat_rate,
  CASE WHEN p_size % 5 > 1 THEN p_type || ' "fin"' END AS description, base || CASE WHEN p_size % 5 > 1 THEN '.jpg,' || base || '-2.jpg,' || base || '-10.jpg' ELSE '.jpg' END AS pictures FROM b""")  # fmt: skip
def pages_budi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue pages, live answers for two thirds of the lots, and the lots' own pages."""
    p, parts = Part(), parts_of(spark, sf_dir)
    picture = lambda key, n, size: _joined("https://media.budi.se/cdn-cgi/image/fit=cover,width=", size, "/auctionobjects/images/k/", key, n, ".jpg")
    iso = F.concat(F.date_format(p.ends + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), lit("&#x2B;02:00"))
    card = _joined(
        '<a href="/objekt/', p.key, '/s" class="budi-auctionobject__card" data-budi-auctionobject-id="', p.key, '" data-budi-auctionobject-endingdatetimeiso="', iso, '" data-budi-auctionobject-isended="', F.when(p.size % 5 == 0, "true").otherwise("false"), '" data-budi-auctionobject-citykey="', c("p_brand"), '"><div><img src="',
        picture(p.key, "", "466"), '" alt="x"><img src="/static/y.svg"></div><time title="08 juli">7d</time><div class="budi-auctionobject__desc"><p title="', c("p_name"), ' &amp; co">kort</p></div><span class="budi-auctionobject__bid-current-amount notranslate">', _spaced(p.size + 1000),
        '&#xA0;kr</span><span class="budi-auctionobject__bid-count-separator"> 9 </span><span class="budi-auctionobject__bid-count notranslate">', p.size % 4, "</span> bud</a>")
    answer = record(
        auctionObjectId=p.key, bidCurrentAmount=record(exVat=F.coalesce(p.bid, lit(0)), vatPercentage=F.when(p.even, 0).otherwise(25)), bidNextAmount=record(exVat=lit(4321)), bidCount=p.size % 4, isReservationPriceMet=p.even, isEnded=lit(False), isBiddingOpen=p.size % 7 > 0)
    answers = parts_of(spark, sf_dir, F.floor(p.key / 100)).filter(p.size % 3 > 0).groupBy("sheet").agg(F.to_json(record(items=F.collect_list(answer))).alias("payload"))
    own = _joined(
        '<meta name="description" content="', c("p_type"), ' &quot;fin&quot;"><b data-budi-servicefee-exvat="99" data-budi-servicefee-dynpercentage-bps="', F.when(p.even, 1600).otherwise(0), '" data-budi-servicefee-dynminexvat="300"></b><img src="', picture(p.key, "-10", "90"), '"><img src="', picture(p.key, "", "90"),
        '"><img src="', picture(p.key, "-2", "90"), '" srcset="', picture(p.key, "-2", "900"), ' 3x"><img src="', picture(lit("x9"), "", "90"), '">')
    lots = parts.filter(p.size % 5 > 1).select(p.key.alias("id"), own.alias("html"))
    rows = cards.budi(readers.budi_payloads(_listed(parts_of(spark, sf_dir, F.floor(p.key / 40)), card, "<h1>830 objekt</h1>", "<a href='/'>0</a>"), answers.select("payload"), lots), ntz(AS_OF))
    return rows.withColumn("pictures", F.array_join("media", ",")).select("external_id", "title", "location", "ends_at", "status", "min_bid", "current_bid", "bid_count", "reserve_status", "fee_value", "vat_rate", "description", "pictures")
