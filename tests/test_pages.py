"""Readers of list pages and lots' own pages."""

import time

import pytest
from pyspark.sql import functions as F

from gavelspark.plans.queries import ORACLE, QUERIES
from gavelspark.sources import houses, pages, pages_houses as readers

from .support import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("pages_")))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), SMALL, ORACLE[name])


LIST = """<div class="item" data-item-id="12"><div><a href="/auktion/objekt/röd-stol/12">x</a><a href="/auktion/objekt/annan/99">y</a>
<img data-src="/tn/small12.JPG"><img data-src="/tn/b.jpg"></div><meta name="title" content="7. Röd &amp; blå &quot;stol&quot;"><br>
<div class="timeWrapper a"><span>23 augusti 15:01</span><span>snart</span></div><p class="itemCurrentBid"><b>1 250 kr</b></p></div>
<div class="item" data-item-id="x1"></div><div class="item" data-item-id="13"><a href="/auktion/objekt/en-lampa/13"></a><i class="itemCurrentBid">Inga bud</i>"""


def test_cards_of_a_list_page(spark):
    df = spark.createDataFrame([(LIST,), (None,), ("<p>no cards</p>",)], "html string")
    got = [tuple(r)[1:] for r in df.lateralJoin(pages.ListCards(F.col("html").outer())).collect()]
    assert got == [("12", "röd-stol", 'Röd & blå "stol"', "23 augusti 15:01", 1250, "/12.JPG"), ("13", "en-lampa", "en lampa", None, None, None)]


def test_terms_of_a_lot(spark):
    page = '<div class="x itemDescription y">En <b>fin</b><div>stol &amp; bord</div></div><p>not this</p><div class="priceInfo" data-purchase-fee="20" data-item-vat="bad"><img itemprop="image" src="a/medium3.jpg"><img data-src="/AuctionItem/3.jpg"><img data-src="/AuctionItem/4.png"><img data-src="/other/5.jpg">'
    df = spark.createDataFrame([(page,), ("<p>x</p>",), (None,)], "html string")
    got = [tuple(r)[1:] for r in df.lateralJoin(pages.LotTerms(F.col("html").outer())).collect()]
    assert got == [("En fin stol & bord", 20.0, 0.0, 0.0, ["a/medium3.jpg", "/AuctionItem/4.png"]), (None, None, None, None, []), (None, None, None, None, [])]


def test_facts_of_a_lot(spark):
    page = "<title>Fåtölj - Sikö Auktioner</title><p>Läs våra villkor här, tack</p><p>kort<p>En <i>gammal</i> fåtölj i skinn<div title='2026-07-03 19:14:00' class='a countdown'></div><b>Utrop:</b> 2 500 kr <img src='https://c/00000042_2.jpg'><img src='/42_1.jpg'><img src='/43_9.jpg'>"
    df = spark.createDataFrame([(42, page), (7, None)], "id long, html string")
    got = {r.id: tuple(r)[2:] for r in df.lateralJoin(pages.LotFacts(F.col("html").outer(), F.col("id").outer())).collect()}
    of = "https://siko-im920.fra1.cdn.digitaloceanspaces.com/{:08}_{}.jpg".format
    assert got[42] == ("Fåtölj", "En gammal fåtölj i skinn", "2026-07-03 19:14:00", 2500, [of(42, 1), of(42, 2)])
    assert got[7] == (None, None, None, None, [of(7, 1)])


READERS = {
    "NetauktionCards": 0, "NetauktionBids": 0, "NetauktionLot": 1, "FabeoLot": 1, "BukowskisCards": 0, "BukowskisLot": 0, "BnaLinks": 0, "BnaLot": 0, "BlintoCards": 0, "BlintoLot": 1, "KronofogdenCards": 0, "KronofogdenLot": 1, "BudiCards": 0, "BudiLot": 1,
}


@pytest.mark.parametrize("name", READERS)
def test_pages_without_lots(spark, name):
    """Lists without a lot yield nothing, a lot's page one row of unknown fields; null keys and pages do no harm."""
    df = spark.createDataFrame([(None, None), ("", "1"), ("<p>x</div></p><", "2")], "html string, id string")
    reader = getattr(readers, name)
    got = df.lateralJoin(reader(F.col("html").outer(), F.col("id").outer()) if READERS[name] else reader(F.col("html").outer())).collect()
    assert len(got) == (3 if name.endswith("Lot") else 0)


@pytest.mark.parametrize("reader", [readers._NetList, readers._BidBox, lambda: readers._FabLot("1"), readers._BukList, readers._BnaLot, readers._BliList, lambda: readers._KroLot("1"), readers._KroList, readers._BudList, pages._Cards, pages._Lot])
def test_a_broken_page_is_read_in_linear_time(reader):
    begin = time.perf_counter()
    readers.read(reader(), "<article id='1' class='category-object-list'><div id='2' class='obj_thumbnail' data-lot-id='3'>" + "<b class='x'>a</i>" * 60000)
    assert time.perf_counter() - begin < 10


STATUS = """[{"product_id":"251391","top_bid":"700","top_bid_with_fee_and_tax":"825","top_bidder":"a","top_bidder_id":"5","is_over_resprice":1,"reserve_met":true,"expiration_datetime":"2026-06-28 19:35:00","is_active":1,"next_ok_bid":"800",
"bid_box":"<h3 class='row'>Budhistorik<\\/h3>\\n<li class=\\"row\\"><div class=\\"date\\"><span>2026-06-22 Kl<br>21:34<\\/span><\\/div><div register_id=\\"5\\"><\\/div><div class=\\"u-name\\"><span>a<\\/span><\\/div><div class=\\"price\\"><b>700 SEK<\\/b><span class=\\"autobid\\">(autobud)<\\/span><\\/div><\\/li>"},
{"product_id":"2","top_bid":"0","is_over_resprice":0,"reserve_met":null,"is_active":0,"expiration_datetime":"2026-06-28 19:35:00","bid_box":null}]"""


def test_answers_with_numbers_for_yes_and_no(spark):
    """The shape of a recorded answer: yes and no come as 1 and 0."""
    lists = spark.createDataFrame([("<article id='251391' class='category-object-list'><a href='/auktion/en-bil?product=251391'></a><div class='object-card-title-text'>Bil</div></article><article id='3' class='category-object-list'><a href='/auktion/c?product=3'></a></article><article id='4' class='category-object-list'>no link</article>",)] * 2, "html string")
    status = spark.createDataFrame([(STATUS.replace("\n", ""),), ("no json",), (None,)], "payload string")
    lots = spark.createDataFrame([("3", "<p>Starttid: 12:30 En sak som ligger i en låda Frakt ordnas")], "id string, html string")
    got = {r.external_id: r for r in houses.netauktion(readers.netauktion_payloads(lists, status, lots), F.lit("2026-06-25 00:00:00").cast("timestamp_ntz")).collect()}
    assert sorted(got) == ["251391", "3"]
    assert (got["251391"].status, got["251391"].reserve_status, got["251391"].current_bid, got["251391"].bid_count, got["251391"].vat_rate) == ("active", "met", 700, 1, 0.0)
    assert (got["3"].status, got["3"].reserve_status, got["3"].vat_rate, got["3"].description) == ("active", None, 25.0, "En sak som ligger i en låda")
    bids = [tuple(r) for r in readers.netauktion_bids(status).collect()]
    assert [(b[0], b[2], b[3], str(b[4])) for b in bids] == [("251391:2026-06-22 21:34:700", 700, "auto", "2026-06-22 19:34:00")]


def test_answers_on_bids(spark):
    live = spark.createDataFrame([("7|1200|x|2026-06-30 10:10:00|1|tis|y|ons||0|1300",), ("<html>",), ("",), (None,), ("x|1",), ("8|",)], "answer string")
    assert sorted(map(tuple, readers.blinto_live(live).collect())) == [("7", 1200, "2026-06-30 10:10:00", 1300), ("8", None, None, None)]
    counts = spark.createDataFrame([('{"7":{"maxbid":"249 000 SEK","numbid":"34 bud"},"8":{}}',), ("no json",), (None,)], "payload string")
    assert sorted(map(tuple, readers.blinto_counts(counts).collect())) == [("7", 249000, 34), ("8", None, None)]
