"""What reading pages costs: each lot is read once, by tasks that do not grow with the table."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gavelspark.plans import queries_sources
from gavelspark.plans.queries import QUERIES
from gavelspark.sources import pages, pages_houses as readers

from .support import SMALL

PIECES = """<p>|</p>|<div class="a b" id='x'>|</div>|<br/>|<br />|<img src="a&amp;b" alt>|<a href=x>|<a href="x"b="y">|<script>|</script>|<script src="x">a<b</script>|<style>p{}</style>|<SCRIPT>|</SCRIPT >|<!-- c -->|<!-- a--b -->|<!--|-->|<!-->|<!doctype html>|<![CDATA[x]]>|<?x?>|&amp;|&|&#38;|&#1;|&nbsp|<|>|</|="|"|<a b = "c">|<a b=''>|<a B="C" b="d">|<x-y>|</h1 x>|<1>|<a/b>|<a b="x>y<z">|<a b="|text|å|\xa0|\0|</>""".split("|")


class Heard(pages.Walk):
    """All that a page's handlers are told."""

    def __init__(self) -> None:
        super().__init__()
        self.told: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.told.append(("start", tag, [(k, v or "") for k, v in attrs]))

    def handle_startendtag(self, tag, attrs):
        self.told.append(("both", tag, [(k, v or "") for k, v in attrs]))

    def handle_endtag(self, tag):
        self.told.append(("end", tag))

    def handle_data(self, data):
        if data:
            self.told.append(("text", data))


def test_markup_is_told_apart_as_by_the_library():
    deal = random.Random(3)
    for _ in range(20_000):
        html = "".join(deal.choice(PIECES) for _ in range(deal.randint(1, 12)))
        ours, theirs = Heard(), Heard()
        ours.read(html)
        theirs.feed(html)
        theirs.close()
        assert ours.told == theirs.told, html


def card(n: int) -> str:
    return f'<div class="item" data-item-id="{n}"><a href="/auktion/objekt/s/{n}"><img data-src="/tn/small1/{n}.jpg"></a><meta name="title" content="{n}. x"><span class="itemCurrentBid">{n} kr</span></div>'


PAGES = {
    "gak list": ("".join(map(card, range(1000, 1600))), pages._Cards),
    "blinto lot": ('<p>En <b>8 SEK</b></p><img src="https://cdn.blinto.se/object/1/1.jpg"><div id="description-content"><p>x</p><ul><li>Rad</li><li>Rad</li></ul></div>' * 300, lambda: readers._BliLot("1")),
    "netauktion lot": ('<div class="a object-description">x <b>y</b> z</div><div class="my-simple-gallery-1"><a href="/uploads/a-m.jpg" itemprop="contentUrl"></a></div>' * 300, lambda: readers._NetLot("1")),
}


@pytest.mark.parametrize("name", PAGES)
def test_reading_costs_little_more_than_telling_tags_apart(name):
    html, reader = PAGES[name]

    def bare():
        parser = HTMLParser()
        parser.feed(html)
        parser.close()

    def seconds(job) -> float:
        begin = time.perf_counter()
        job()
        return time.perf_counter() - begin

    ours, theirs = (min(seconds(job) for _ in range(7)) for job in (lambda: readers.read(reader(), html), bare))
    assert ours < 1.7 * theirs


def test_the_links_of_a_card(spark):
    href = "/auktion/objekt/auktion/objekt/b/12?x=/auktion/objekt/c/12"
    page = f'<div class="item" data-item-id="12"><a href="/auktion/objekt/a/99"></a><a href="/AUKTION/objekt/å/x/12"></a><a href="{href}"></a></div>'
    assert [c["slug"] for c in readers.read(pages._Cards(), page).cards] == ["b"]


@pytest.mark.parametrize("name", ["pages_blinto", "pages_gak", "pages_netauktion"])
def test_payloads_are_parsed_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    mapper = "from_json(ArrayType(StructType(StructField(product_id,StringType,true),StructField(title" if name == "pages_netauktion" else "from_json(StructField(item"
    assert plan.count(mapper) == 1


def test_tasks_follow_the_number_of_lots(spark, monkeypatch):
    monkeypatch.setattr(queries_sources, "LOTS_A_TASK", 5)
    parts = queries_sources.parts_of(spark, SMALL)
    assert parts.rdd.getNumPartitions() == parts.count() / 5
    sheets = queries_sources._listed(queries_sources.parts_of(spark, SMALL, F.floor(F.col("p_partkey") / 10)), F.col("p_name"), "", "")
    assert sheets.rdd.getNumPartitions() == parts.count() / 5 and sheets.count() == parts.count() / 10


def test_pages_by_batches_are_what_the_table_function_yields(spark):
    row = lambda n: f"<li class='row'><b>{n} SEK</b><i>2026-06-22 Kl<br>21:34</i></li>"
    df = spark.createDataFrame([(1, "".join(row(n) for n in range(6000))), (2, None), (3, "<p>x</p>"), (4, row(7) + row("9" * 30))], "k int, html string")
    there = df.lateralJoin(readers.NetauktionBids(F.col("html").outer())).drop("html")
    here = pages.read_pages(df, readers.NetauktionBids, "html")
    assert here.schema == there.schema
    assert sorted(map(repr, here.collect())) == sorted(map(repr, there.collect())) and here.count() == 6002
    assert [r.value for r in here.filter("k = 4").collect()] == [7, None]
