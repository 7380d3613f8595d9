"""Known cases of scalar functions, in one job each."""

import pytest
from pyspark.sql import functions as F

from gavelspark.functions import text as T, times, vectors
from gavelspark.rules import classify
from gavelspark.sources import html as H

CASES = [
    ("lot_count", T.lot_count, [("6 st stolar", 6), ("Ett par ljusstakar", 2), ("stolar, par", 2), ("Stol", None), (None, None), ("12 stycken glas", 12), ("0 st", None)]),
    ("plate", T.plate, [("Volvo ABC123 röd", "ABC123"), ("abc 12d", "ABC12D"), ("AAA000", None), ("ingen", None), (None, None)]),
    ("number", T.number, [("1 234,50", 1234.5), ("12.500", 12500.0), ("3,5", 3.5), ("x", None), (None, None), ("7", 7.0)]),
    ("slug", T.slug, [("Åkerö & Söner, 2:a", "akero-soner-2-a"), ("  Café Noir ", "cafe-noir"), ("", ""), (None, None)]),
    ("countdown", times.countdown_seconds, [("3 dygn 10 tim", 295200), ("46 minuter", 2760), ("5 sek", 5), ("snart", None), (None, None)]),
    ("quoted_models", lambda x: F.array_join(T.quoted_models(x), "|"), [('Fåtölj "Jetson" av "Bruno M"', "Jetson|Bruno M"), ('"x"', ""), ("ingen", ""), ("”Lamino” stol", "Lamino"), ('"Boxer 20" och "Model 11"', "Boxer 20|Model 11")]),
    ("condition_badge", T.condition_badge, [("Ny i kartong", "ny"), ("helt oanvänd vara", "ny"), ("ej testad", "otestad"), ("begagnad", None), ("oanvändbar", None), (None, None)]),
    ("normalise_query", T.normalise_query, [("  Röd   STOL ", "röd stol"), ("", ""), (None, None)]),
    ("clock_minutes", times.clock_minutes, [("8:05", 485), ("23:59", 1439), ("24:00", None), ("x", None)]),
    ("strip_html", T.strip_html, [("<p>A &amp; B</p><script>x</script> <b>c</b>", "A & B c"), ("&lt;b&gt;", "<b>"), ("", ""), (None, None)]),
    ("item_text", lambda x: T.item_text(F.lit("Stol"), x), [("  röd \n fin ", "Stol. röd fin"), ("", "Stol"), (None, "Stol")]),
    ("label_value", lambda x: T.label_value(x, "Höjd", ("Bredd", "Vikt")), [("Höjd: 30 cm Bredd: 10", "30 cm"), ("Vikt: 2", None), (None, None)]),
    ("image_url", T.image_url, [("https://a/b_thumb.jpg", "https://a/b.jpg"), ("https://a/b-640x480.png", "https://a/b.png"), ("https://a/b.jpg", "https://a/b.jpg"), (None, None)]),
    ("fitted", lambda x: T.fitted(x, 10), [("kort", "kort"), ("en längre text", "en längre…"), (None, None)]),
    ("worth_expanding", T.worth_expanding, [("ring", True), ("12 34", False), ("abc", False), (None, None)]),
    ("by_text", classify.by_text, [("Volvo V70 kombi 2008", "fordon/personbilar"), ("Guldring 18k med safir", "smycken/smycken-sub"), ("Matta, stol och dator", "ovrigt/partier"), ("Diverse dödsbo", "ovrigt/partier"), ("Okänd sak", None), ("LP-skiva vinyl Abba", "media/vinyl")]),
    ("allow_tags", T.allow_tags, [("<P onclick='x'>a</p>", "<p>a</p>"), ('<img src="a>b" onerror=x>c', " c"), ("<script>alert(1)</script>d", " d"), ("1 < 2 > 0", "1 &lt; 2 &gt; 0"), ("<b>x", "<b>x"), ("<bold>x</bold>", " x "), ("<p title=\"it's\">y</p>", "<p>y</p>"), ("<p title=\"open>z", "&lt;p title=\"open&gt;z"), (None, None), ("", "")]),
    ("condition", T.condition, [("Helt NY", "new"), ("nycklar", "used"), ("oanvänd", "new"), ("begynna", "used")]),
    ("stated_brand", T.stated_brand, [("Märke: IKEA stol", "IKEA"), ("Fabrikat = Volvo, röd", "Volvo"), ("<p>Tillverkare: Källemo</p>", "Källemo"), ("ingen", None), (None, None)]),
    ("exact_local", times.exact_local, [("Slutar 2026-06-30 10:10:05", "2026-06-30T08:10:05"), ("2026-01-30T10:10", "2026-01-30T09:10:00"), ("snart", None), (None, None)]),
    ("event_title", __import__("gavelspark.sources.houses_cards", fromlist=["x"]).event_title, [("2026 05 12 konkurs i Umeå", "Konkurs i Umeå"), ("2026 05 12", "2026 05 12"), ("dödsbo", "Dödsbo")]),
]


@pytest.mark.parametrize("name,fn,pairs", CASES, ids=[x[0] for x in CASES])
def test_known_cases(spark, name, fn, pairs):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string")
    got = {r.i: r.y for r in rows.select("i", fn(F.col("x")).alias("y")).collect()}
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    assert {pairs[i][0]: plain(v) for i, v in got.items()} == dict(pairs)


def test_dates_without_a_year(spark):
    now = F.expr("TIMESTAMP_NTZ '2026-08-01 12:00:00'")
    rows = spark.createDataFrame([("Mån 29 jun 09:59",), ("23 augusti 15:01",), ("31 jul 20:00",), ("32 foo 10:00",), (None,), ("29 feb 10:00",)], "x string")
    got = {r.x: (r.f and r.f.isoformat(), r.p and r.p.isoformat()) for r in rows.select("x", times.yearless(F.col("x"), now).alias("f"), times.yearless(F.col("x"), now, past=True).alias("p")).collect()}
    assert got["Mån 29 jun 09:59"] == ("2027-06-29T07:59:00", "2026-06-29T07:59:00")
    assert got["23 augusti 15:01"] == ("2026-08-23T13:01:00", "2025-08-23T13:01:00")
    assert got["31 jul 20:00"] == ("2026-07-31T18:00:00", "2026-07-31T18:00:00")
    assert got["32 foo 10:00"] == got[None] == (None, None) and got["29 feb 10:00"] == (None, None)


def test_polyline(spark):
    rows = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), ("",), (None,)], "x string")
    got = {r.x: r.y and [(p.lat, p.lon) for p in r.y] for r in rows.select("x", vectors.polyline(F.col("x")).alias("y")).collect()}
    assert got["_p~iF~ps|U_ulLnnqC_mqNvxq`@"] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert not got[""] and got[None] is None


def test_sanitised_markup_has_no_other_tags(spark):
    """Whatever goes in, only bare known tags come out."""
    import random
    import re

    r = random.Random(3)
    pieces = ["<p>", "</p>", "<", ">", '"', "'", "<img src=x onerror=y>", "<scr", "ipt>", "<script>", "</script>", " a=b", "text", "<!--", "-->", "<b ", "<B/>", "\x01", "\x02p", "&lt;"]
    rows = spark.createDataFrame([("".join(r.choice(pieces) for _ in range(r.randint(1, 14))),) for _ in range(400)], "x string")
    for row in rows.select("x", T.allow_tags(F.col("x")).alias("y")).collect():
        assert set(re.findall("<[^>]*>?", row.y)) <= {f"<{s}{t}>" for t in T.SAFE_TAGS for s in ("", "/")}, row.x


def test_lot_facts(spark):
    from gavelspark.sources.houses_cards import lot_facts

    page = '<td class="varurubrik">Auktnr</td> <td class="varuvarde">17</td><td class="varurubrik">Utropspris</td><td class="varuvarde">5</td><td class="varurubrik">Frakt</td><td class="varuvarde"> </td><td class="varurubrik">Kontor</td><td class="varuvarde">Umeå</td>'
    rows = spark.createDataFrame([(page,), ("none",)], "x string").select(lot_facts(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == ["Auktnr: 17\nKontor: Umeå", None]


def test_export_and_pages(spark, tmp_path):
    from gavelspark.operators.queues import numbered_pages

    sales = spark.createDataFrame([('En "fin" stol', "tovek", "2026-01-02 03:04:05", 100, None), ("Å", "bna", None, 5, 7)], "title string, house string, ended_at string, final_bid long, final_total long")
    H.export_prices(sales.coalesce(1), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith(b'"\xef\xbb\xbftitel","hus","datum","bud_kr","total_kr"') and '"En ""fin"" stol","tovek","2026-01-02","100","100"'.encode() in raw
    H.write_pages(numbered_pages(spark.range(95).withColumnRenamed("id", "k"), "k", 40), str(tmp_path / "pages"))
    got = spark.read.parquet(str(tmp_path / "pages")).groupBy("page").agg(F.count("*").alias("n"), F.min("k").alias("k")).collect()
    assert sorted(map(tuple, got)) == [(0, 40, 0), (1, 40, 40), (2, 15, 80)]


def test_capped_ranges_end_on_a_single_value(spark):
    """Twenty halvings do not do for a wide span; a value over the cap is marked."""
    from gavelspark.operators.queues import capped_ranges

    rows = spark.createDataFrame([("a", v) for v in [0] * 3 + [1, 2, 3] + [1 << 40] + [(1 << 40) + 1]], "b string, v long")
    leaves = capped_ranges(rows, "b", "v", cap=1).collect()
    assert sum(r.n for r in leaves) == 8 and all(r.n <= 1 or r.low == r.high for r in leaves)
    assert [(r.low, r.n) for r in leaves if r.over_cap] == [(0, 3)]


def test_estimates_leave_own_and_rejected_sales_out(spark):
    from gavelspark.operators import price

    attrs = "attrs struct<b:string,m:string,d:string,t:string,y:int>"
    fact = lambda b=None, y=None: (b, None, None, None, y)
    title = "Silverfat graverat"
    targets = spark.createDataFrame([("h", str(i), title, "silver/fat", fact("Gense" if i == 3 else None, 1900 if i == 4 else None)) for i in range(5)], f"house string, external_id string, title string, category string, {attrs}")
    sales = [("h", str(i), title, "silver/fat", 10 * i, fact("GAB" if i in (11, 12) else None, 1950 if i == 13 else None), True, i) for i in (0, 10, 11, 12, 13, 14)]
    history = spark.createDataFrame([(h, e, t, c, p, p, a, s, n) for h, e, t, c, p, a, s, n in [(x[0], x[1], x[2], x[3], x[4] + 5, x[5], x[6], x[7]) for x in sales]], f"house string, external_id string, title string, category string, final_bid long, final_total long, {attrs}, sold boolean, ended_at int")
    rejected = spark.createDataFrame([("h", "1", "h", "10"), ("h", "1", "h", "99")], "house string, external_id string, cmp_house string, cmp_external_id string")
    got = {r.external_id: (r.n, r.low, r.high) for r in price.estimates(targets, history, rejected).collect()}
    # all six; own sale out; one rejected; another brand out; a year too far off
    assert got == {"0": (5, 105, 145), "1": (5, 5, 145), "2": (6, 5, 145), "3": (4, 5, 145), "4": (5, 5, 145)}


def test_sources_refetch_probe_and_hang_together(spark):
    import sys

    from pyspark import cloudpickle

    from gavelspark.sources.paged import hierarchy, probe_ids, refetch, register_paged

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    alive = lambda ids: [{"id": int(i), "title": f"lot {i}"} for i in ids if i % 3 and i < 430]
    kinds = "id long, title string"
    got = refetch(spark.range(10), "id", kinds, alive, size=4).collect()
    assert sorted(r.id for r in got) == [1, 2, 4, 5, 7, 8]
    found = probe_ids(spark, kinds, alive, start=100, size=10, wave=4)
    assert sorted(r.id for r in found.collect()) == [i for i in range(100, 430) if i % 3]
    calls = {"parts": [{"part": 1}, {"part": 2}], "lots": [{"part": 1, "lot": 10}, {"part": 9, "lot": 90}], "offers": [{"lot": 10, "value": 5}, {"lot": 90, "value": 6}]}
    for name, schema in (("parts", "part long"), ("lots", "part long, lot long"), ("offers", "lot long, value long")):
        rows = calls[name]
        register_paged(spark, f"t_{name}", schema, lambda shard, page, rows=rows: ([rows[page - 1]], len(rows)))
    parts, lots, offers = hierarchy(spark, "t_parts", "t_lots", "t_offers", "part", "lot")
    assert (parts.count(), [r.lot for r in lots.collect()], [r.value for r in offers.collect()]) == (2, [10], [5])


def test_vectors_as_bytes(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None), (4, [1.0, None]), (5, [float("nan")])], "k int, v array<double>")
    packed = {r.k: r.b for r in rows.select("k", vectors.vector_bytes(F.col("v")).alias("b")).collect()}
    assert (packed[1], packed[2], packed[3], packed[4]) == (b"\x00\x00\x80\x3f\x00\x00\x20\xc0", b"", None, None) and len(packed[5]) == 4
    kept = spark.createDataFrame([(1, bytes(packed[1])), (2, b""), (3, None), (4, b"abc")], "k int, b binary")
    assert [r.v for r in kept.orderBy("k").select(vectors.bytes_vector(F.col("b")).alias("v")).collect()] == [[1.0, -2.5], None, None, None]
