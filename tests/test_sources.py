"""Mappers on hand-written payloads of the sources' shapes, the paged source, the row-stream decoder, HTML fields."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gavelspark.sources import flight, html, houses
from gavelspark.sources.contract import ITEM_COLUMNS, all_sources
from gavelspark.sources.paged import register_paged


def now():
    return F.expr("TIMESTAMP_NTZ '2026-08-01 12:00:00'")


def payloads(spark, *texts):
    return spark.createDataFrame([(t if t is None or isinstance(t, str) else json.dumps(t),) for t in texts], "payload string")


def rows(df):
    assert df.columns == list(ITEM_COLUMNS)
    return {r.external_id: r for r in df.collect()}


def test_flat_list_with_epoch_times(spark):
    lot = {"id": 7, "title": "Volvo V70", "city": "Umeå", "region": "Norr", "starting_price": 1000, "current_price": 2500, "reservations_pris": True, "auction_end": 1785585600000 + 86_400_000, "bid_count": 3, "active": True, "photos": ["https://x/a_thumb.jpg", "b.jpeg"]}
    got = rows(houses.frivio(payloads(spark, [lot, {**lot, "id": 8, "bid_count": 0, "auction_end": 0, "reservations_pris": False}], None, "not json"), now()))
    assert (got["7"].status, got["7"].current_bid, got["7"].reserve_status, got["7"].media, got["7"].location) == ("active", 2500, None, ["https://x/a.jpg", "https://backend.frivio.se/vehicle/7/b.jpeg"], "Umeå")
    assert (got["8"].status, got["8"].current_bid, got["8"].reserve_status) == ("ended", None, None)
    assert json.loads(got["7"].raw)["title"] == "Volvo V70"


def test_stepwise_fee_of_a_reserve(spark):
    lots = [{"remoteId": "a", "name": "Ring", "numBids": 2, "currentPrice": 900, "reservationPrice": 1000, "reservationPriceMet": False, "endTimeUtc": "2026-08-02T10:00:00", "status": 2}, {"remoteId": "b", "name": "Ur", "numBids": 0, "currentPrice": 0, "withoutReservationPrice": True, "endTimeUtc": "2026-08-02T10:00:00", "status": 3}]
    got = rows(houses.junora(payloads(spark, {"auctions": lots}), now()))
    assert (got["a"].fee_value, got["a"].reserve_status, got["a"].status, got["a"].ends_at.isoformat()) == (265, "not_met", "active", "2026-08-02T10:00:00")
    assert (got["b"].fee_value, got["b"].reserve_status, got["b"].status, got["b"].current_bid) == (None, "none", "ended", None)


def test_external_fee_source(spark):
    got = rows(houses.retrade(payloads(spark, {"auctions": [{"id": "1", "heading": "Truck", "highestBid": 28000, "auctionEnd": "2026-08-03T10:00:00Z"}, {"id": "2", "heading": "Bil", "highestBid": 0, "auctionEnd": "2026-08-03T10:00:00Z", "isSold": True}]}), now()))
    assert (got["1"].current_bid, got["1"].status, got["1"].currency) == (28000, "active", "SEK")
    assert (got["2"].current_bid, got["2"].status) == (None, "ended")


def test_vat_from_the_exact_total(spark):
    lot = {"product_id": "1", "top_bid": "1000", "top_bid_with_fee_and_tax": "1400", "fee": 120.0, "is_active": True, "expiration_datetime": "2026-08-02 14:00:00", "reserve_met": True}
    got = rows(houses.netauktion(payloads(spark, [lot, {**lot, "product_id": "2", "top_bid_with_fee_and_tax": "1150"}, {**lot, "product_id": "3", "top_bid": "x"}]), now()))
    assert (got["1"].vat_rate, got["2"].vat_rate, got["1"].ends_at.hour, got["3"].current_bid) == (25.0, 0.0, 12, None)


def test_bids_in_a_lot(spark):
    lot = {"id": 5, "highest": "300", "sold": False, "reservationPriceReached": False, "noReserve": True, "bids": [{"bid": "200", "date": "2026-07-01T10:00:00Z", "bidder": "secret", "vat": 25}, {"bid": "300", "date": "2026-07-02T10:00:00Z", "vat": 25}], "endingDate": "2026-08-05T10:00:00Z"}
    got = rows(houses.psauction(payloads(spark, lot), now()))["5"]
    assert (got.current_bid, got.bid_count, got.reserve_status, got.vat_rate) == (300, 2, "none", 25.0)
    bids = houses.psauction_bids(payloads(spark, lot))
    assert "bidder" not in bids.columns and sorted(r.value for r in bids.collect()) == [200, 300]


def test_search_envelope_and_nested_batches(spark):
    doc = {"id": "v1", "title": "Klocka", "price": 400, "bids_count": 1, "end_time": 1790000000, "is_reserve_met": True, "location_city": "Kalmar"}
    got = rows(houses.vaxxa(payloads(spark, {"results": [{"found": 1, "hits": [{"document": doc}]}]}), now()))
    assert (got["v1"].current_bid, got["v1"].reserve_status, got["v1"].location) == (400, "met", "Kalmar")
    batch = [{"Query": "q", "Page": 1, "PageSize": 1, "Total": 2, "Result": [{"LotId": {"AuctionId": "+221", "LotId": "9"}, "Name": {"se": "Hjullastare"}, "AuctionName": {"en": "Sale", "se": "Rea"}, "BidStatus": {"BiddingFinished": True}, "CurrentBid": 0, "ReservedPriceMet": False, "Images": [{"Id": "a", "Version": "2"}]}]}]
    lot = rows(houses.bidflow(payloads(spark, batch), now()))["221-9"]
    assert (lot.title, lot.description, lot.status, lot.current_bid, lot.media) == ("Hjullastare", "Rea", "ended", None, ["https://img.imageboss.me/2/width/1600/withoutEnlargement:true/a"])
    auction = [{"auctionId": 1, "name": "Konkurs", "endDate": "2026-09-01T10:00:00Z", "catalogText": "<p>Allt &amp; mer</p>"}, {"auctionId": 2, "name": "Test 1", "endDate": "2026-09-01T10:00:00Z"}]
    both = all_sources([houses.upplands(payloads(spark, auction), now()), houses.vaxxa(payloads(spark, {"results": []}), now())])
    assert [(r.external_id, r.description) for r in both.collect()] == [("1", "Allt & mer")]


def test_typed_values(spark):
    df = spark.createDataFrame([('{"stringValue":"a"}',), ('{"integerValue":"7"}',), ("{}",), (None,)], "v string")
    assert [r[0] for r in df.select(houses.typed_value(F.col("v"))).collect()] == ["a", "7", None, None]


def test_row_stream(spark):
    text = "åäö, and\nmore"
    payload = f'0:["$L1",{{"items":["$2","$9"]}}]\n1:T{len(text.encode()):x},{text}2:{{"lot":1,"text":"$1","self":"$2"}}\nnoise\n3:{{bad\n'
    found = flight.read_rows(payload)
    assert found["1"] == text and flight.resolve(found["2"], found, frozenset("2")) == {"lot": 1, "text": text, "self": None}
    df = spark.createDataFrame([("k", payload), ("e", None)], "key string, payload string")
    got = flight.decode(df, "lot").collect()
    assert {r.key for r in got} == {"k"} and all(json.loads(r.object)["text"] == text for r in got)


def fetch(shard, page):
    pages = {"a": [[{"id": 1}, {"id": 2, "x": "p"}], [{"id": 3}]], "b": [[{"id": 4}]], "empty": [[]]}
    return pages[shard][page - 1], len(pages[shard])


def test_paged_source(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    register_paged(spark, "lots_pages", "id long, x string", fetch, ["a", "b", "empty"])
    df = spark.read.format("lots_pages").load()
    assert sorted((r.id, r.x) for r in df.collect()) == [(1, None), (2, "p"), (3, None), (4, None)]
    assert df.rdd.getNumPartitions() == 4
    query = spark.readStream.format("lots_pages").load().writeStream.format("memory").queryName("swept").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(200):
            if {r.id for r in spark.table("swept").collect()} == {1, 2, 3, 4}:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert {r.id for r in spark.table("swept").collect()} == {1, 2, 3, 4}


def test_html_fields(spark):
    page = "<table><tr><th>Märke:</th><td><b>Volvo</b></td></tr><tr><td>Antal</td><td>1 234 kr</td></tr></table><dl><dt>Märke</dt><dd>Saab</dd><dt>Färg</dt><dd>Röd &amp; vit</dd></dl>"
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")
    got = {r.page_id: r.m for r in df.select("page_id", html.label_values(F.col("html")).alias("m")).collect()}
    assert got == {1: {"Märke": "Volvo", "Antal": "1 234 kr", "Färg": "Röd & vit"}, 2: {}, 3: None}
    assert [(r.label, r.value) for r in html.table_series(df, "page_id").collect()] == [("Antal", 1234.0)]


def test_verdicts_of_an_answer(spark):
    from gavelspark.sources import answers

    text = '```json\n[{"i":0,"k":"media/vinyl","n":3,"b":" Abba  Band ","y":1976},{"k":"elektronik/hittepa","i":1},{"i":0,"k":"media/film"},{"i":9,"k":"media/film"},{"i":2,"k":"nonsense"},{"i":2,"k":"fordon/personbilar","n":0,"reg":"abc 123","y":3000},{"i":3,"k":"media/f'
    df = spark.createDataFrame([("x", text, 4), ("y", None, 4), ("z", "no objects", 1)], "batch string, answer string, n_rows int")
    got = {r.i: r for r in answers.verdicts(df, "batch", "answer", "n_rows").collect()}
    assert {i: (r.category, r.n) for i, r in got.items()} == {0: ("media/vinyl", 3), 1: ("elektronik", None), 2: ("fordon/personbilar", None)}
    assert (got[0].attrs.b, got[0].attrs.y, got[1].attrs, got[2].attrs.reg, got[2].attrs.y) == ("Abba Band", 1976, None, "ABC123", None)


def test_expansion_of_a_query(spark):
    from gavelspark.sources import answers

    df = spark.createDataFrame([('{"synonyms":["RAM-minne"," ram ","minne","ram minne","DDR4","ddr4","x"],"related":[],"categories":["elektronik/datorer","nope"]}',), ("sorry",), (None,)], "a string")
    got = [r[0] for r in df.select(answers.expansion(F.col("a"), F.lit("Ram minne"))).collect()]
    assert (got[0].synonyms, got[0].related, got[0].categories) == (["ram-minne", "ddr4"], [], ["elektronik/datorer"]) and got[1] is None and got[2] is None


def test_verdicts_are_applied_by_rank(spark):
    from gavelspark.sources import answers

    attrs = "struct<b:string,m:string,d:string,t:string,mat:string,y:int,reg:string>"
    items = spark.createDataFrame([("1", "A", "x/y", "human", True, 2, None), ("2", "B", "x/y", "text", True, 2, ("old", "keep", None, None, None, None, None)), ("3", "C", None, "none", None, None, None)], f"id string, title string, category string, category_conf string, category_conflict boolean, lot_count int, attrs {attrs}")
    found = spark.createDataFrame([("1", "media/film", 1, None), ("2", "media/film", None, ("new", None, None, None, None, 1990, None)), ("3", "ovrigt/diverse", 4, None)], f"id string, category string, n int, attrs {attrs}")
    after, learn = answers.apply_verdicts(items, found, ["id"])
    got = {r.id: r for r in after.collect()}
    assert got["1"].category == "x/y" and (got["2"].category, got["2"].lot_count, got["2"].attrs.b, got["2"].attrs.m, got["2"].attrs.y) == ("media/film", 2, "new", "keep", 1990)
    assert (got["3"].category_conf, got["3"].lot_count) == ("llm", 4) and [tuple(r) for r in learn.collect()] == [("B", "media/film")]


def test_source_category_names(spark):
    from gavelspark.rules.classify import by_name

    df = spark.createDataFrame([("Vinyl & LP",), ("Frimärken Sverige",), ("Något annat",), (None,)], "n string")
    assert [r[0] for r in df.select(by_name(F.col("n"))).collect()] == ["media/vinyl", "samla/frimarken", None, None]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a \"quoted\", text", 1), ("åäö", None)]
    html.write_csv(spark.createDataFrame(rows, "titel string, bud long"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').schema("titel string, bud long").csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_routes_refuse_too_many_stops(spark):
    from gavelspark.operators.route import MOST, plan_routes

    kinds = "route_id long, stop_id long, lat double, lon double, opens double, closes double, depot boolean"
    stop = lambda route, k: (route, k, 57.0 + k / 100, 12.0, 480.0, 900.0, k == 0)
    stops = spark.createDataFrame([*(stop(1, k) for k in range(MOST + 2)), *(stop(2, k) for k in range(3)), stop(3, 0)], kinds)
    got = plan_routes(stops).collect()
    assert sorted((r.route_id, r.place) for r in got if not r.refused) == [(2, 0), (2, 1), (2, 2), (2, 3)]
    assert sorted(r.route_id for r in got if r.refused) == [1, 3]


def test_shapes_of_recorded_answers(spark):
    """The shapes in which the sources were recorded: results as words, amounts with decimals, yes and no as numbers,
    local times, file names of pictures, old ids."""
    at = F.lit("2026-06-25 00:00:00").cast("timestamp_ntz")
    lots = [{"Query": {"AuctionId": "+221", "Language": "se"}, "Page": 1, "PageSize": 100, "Total": 76, "Result": [
        {"LotId": {"AuctionId": "+221", "LotId": "+1"}, "Name": {"se": "Volvo BM 350 "}, "AuctionName": {"en": "", "se": "Juniauktion"}, "BidStatus": {"BiddingFinished": "Sold"}, "CurrentBid": 28000, "ReservedPriceMet": True, "ReservedPrice": None, "Estimate": 0, "Images": [{"Id": "6b", "Version": "byraneffecta"}], "LotLocation": {"Address": {"Address": "Gård 1"}}},
        {"LotId": {"AuctionId": "+222", "LotId": "+2"}, "Name": {"se": "Plog"}, "BidStatus": {}, "CurrentBid": None, "ReservedPriceMet": None, "Images": []}]}]
    catalogue = {"ActiveAuctions": [{"Id": "+222", "Date": "2026-07-25T10:00:00+02:00", "Status": "Open", "HeadInfo": {"Head": {"se": "Gårdsauktion-Momsfri"}, "ViewingText2": {}}}], "HistoryAuctions": [{"Id": "+221", "Date": "2026-06-24T10:00:00+02:00", "Status": "Finished", "HeadInfo": {"Head": {"en": "", "se": "Juniauktion"}}}]}
    got = rows(houses.bidflow(payloads(spark, lots), at, "sajab", houses.bidflow_auctions(payloads(spark, catalogue, "no json"))))
    assert (got["221-1"].status, got["221-1"].title, got["221-1"].reserve_status, got["221-1"].location, got["221-1"].vat_rate) == ("ended", "Volvo BM 350", "met", "Gård 1", None)
    assert (got["222-2"].status, got["222-2"].ends_at.isoformat(), got["222-2"].reserve_status, got["222-2"].vat_rate) == ("active", "2026-07-25T08:00:00", None, 0.0)

    item = {"id": 1840151, "highest": "100.00", "sold": True, "reservationPriceReached": True, "nextBid": "200", "bidVatLabel": "exkl 25% moms", "currency": "SEK", "bids": [{"bid": "100.00", "date": "2026-06-27 15:54", "bidder": "x", "bidderId": 1, "currency": "SEK", "vat": 25}], "active": 1, "cancelled": 0, "endingDate": "2026-06-28 14:00"}
    got = rows(houses.psauction(payloads(spark, item), at))["1840151"]
    assert (got.status, got.current_bid, got.min_bid, got.bid_count, got.vat_rate, got.ends_at.isoformat()) == ("active", 100, 200, 1, 25.0, "2026-06-28T12:00:00")
    assert [tuple(map(str, r)) for r in houses.psauction_bids(payloads(spark, item)).collect()] == [("1840151:2026-06-27 15:54:100", "1840151", "100", "2026-06-27 13:54:00")]

    vehicle = {"title": "560 LU", "id": 596, "year": 2019, "region": "Blekinge", "active": True, "city": "Karlshamn", "brand": "Hobby", "photos": ["a1.jpeg"], "reservations_pris": False, "auction_end_state": None, "starting_price": 105000, "current_price": 136000, "hammer_fee": 5, "auction_end": 1782830160000, "bid_count": 4}
    got = rows(houses.frivio(payloads(spark, [vehicle, {**vehicle, "id": 597, "auction_end_state": "sold"}]), at))
    assert (got["596"].title, got["596"].status, got["596"].media, got["597"].status) == ("Hobby 560 LU", "active", ["https://backend.frivio.se/vehicle/596/a1.jpeg"], "ended")

    doc = {"bids_count": 1, "end_time": 1782925380, "id": "04e2", "image_url": "https://images.vaxxa.se/215911/s=list/4.jpg", "is_reserve_met": True, "listing_type": "AUCTION", "location_city": "Lövestad", "old_id": "215911", "price": 100, "title": "Taksteg"}
    buy = {**doc, "old_id": "7", "bids_count": 0, "listing_type": "BUY_NOW", "is_reserve_met": False}
    got = rows(houses.vaxxa(payloads(spark, {"results": [{"found": 167, "hits": [{"document": doc, "highlight": {}}, {"document": buy}]}]}), at))
    assert (got["215911"].current_bid, got["215911"].min_bid, got["215911"].source_url) == (100, None, "https://app.vaxxa.se/auctions/215911")
    assert (got["7"].current_bid, got["7"].min_bid, got["7"].reserve_status) == (None, 100, "not_met")

    data = {"props": {"pageProps": {"inventoryItems": [{"auctionId": 81, "description": "<p>Höjd 75 </p>", "endDate": "2026-07-12T13:23:54.02Z", "hasReserve": False, "highBid": 10000, "id": 20460, "minBid": 50, "name": 'Spegel "1011"', "reserveMet": True, "defaultImage": {"images": [{"url": "u"}, {"url": "u"}]}}, {"auctionId": 82, "id": 5, "highBid": 0}]}}}
    page = spark.createDataFrame([(f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>',), ("<html>",), (None,)], "html string")
    terms = [{"auctionId": 81, "name": "Auktion", "endDate": "2026-07-12T13:00:00Z", "winnersGenerated": False, "buyersPremium": 20, "hammerFees": {"buyer": {"total": 30}}}, {"auctionId": 82, "name": "Test 2", "buyersPremium": 20}]
    for known in (terms, {"auctions": terms}):
        got = rows(houses.upplands_lots(page, payloads(spark, known, None, "no json"), at))
        assert (got["20460"].fee_value, got["20460"].vat_rate, got["20460"].reserve_status, got["20460"].media, got["20460"].description) == (2530, 0.0, "none", ["u"], "Höjd 75")
        assert (got["5"].title, got["5"].fee_value, got["5"].current_bid, got["5"].status) == ("Objekt 5", None, None, "active")
