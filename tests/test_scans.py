"""A search with a ceiling read whole: slices, probes, partitions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gavelspark.plans.queries import ORACLE, QUERIES
from gavelspark.plans.queries_scans import recorded_items
from gavelspark.sources import sliced
from gavelspark.sources.sliced import Answer, Slice

from .support import SMALL, assert_same


class Table:
    """A search over rows in memory: (key, category, price, county), categories as paths."""

    def __init__(self, rows, cap, page=10):
        self.rows, self.cap, self.page, self.asked = rows, cap, page, Counter()

    def __call__(self, s, page):
        self.asked[s, page] += 1
        rows = [r for r in self.rows if (s.category is None or r["category"] == s.category or r["category"].startswith(s.category + "/")) and (s.priced is None or (r["price"] is not None) == s.priced)]
        rows = [r for r in rows if (s.low is None or r["price"] >= s.low) and (s.high is None or r["price"] < s.high) and all(r[n] == v for n, v in s.facets)]
        depth = 0 if s.category is None else s.category.count("/") + 1
        children = Counter("/".join(r["category"].split("/")[: depth + 1]) for r in rows if r["category"].count("/") >= depth)
        return Answer(rows[: self.cap][(page - 1) * self.page : page * self.page], len(rows), sorted(children.items()))


def read(search, found):
    """What a reader gets from a plan."""
    reader = sliced._Sliced(search, {}, ["key"], search.cap, 0.0, None)
    return [[k for (k,) in reader.read(sliced.Leaf(s, a))] for s, a in found.leaves]


def rows(n, **fixed):
    return [{"key": i, "category": f"m{i % 3}/s{i % 7}", "price": i * i % 9000, "county": f"c{i % 4}"} | fixed for i in range(n)]


def check(search, facets, factor=3):
    found = sliced.plan(search, facets, search.cap)
    got = read(search, found)
    assert sorted(k for leaf in got for k in leaf) == sorted(r["key"] for r in search.rows) and not found.missing
    assert all(len(leaf) <= search.cap for leaf in got)
    # a cut of a slice over the cap asks for as many parts as it makes, and no question is asked twice
    assert found.probes == sum(1 for (_, page) in search.asked if page == 1) and max(search.asked.values()) == 1
    return found


def test_small_source_is_one_partition():
    assert len(check(Table(rows(40), 50), {}).leaves) == 1


def test_categories_then_prices():
    found = check(Table(rows(3000), 50), {})
    assert found.probes <= 6 * len(found.leaves)


def test_equal_prices_go_by_facets():
    found = check(Table(rows(160, price=700, category="m"), 50), {"county": ["c0", "c1", "c2", "c3"]})
    assert {dict(s.facets).get("county") for s, _ in found.leaves} == {"c0", "c1", "c2", "c3"}


def test_rows_without_a_price_and_dear_ones():
    check(Table(rows(60, category="m") + [{"key": 1000 + i, "category": "m", "price": None if i % 2 else 10**9 + i, "county": "c0"} for i in range(80)], 50), {"county": ["c0", "c1", "c2", "c3"]})


def test_children_that_do_not_make_up_the_whole():
    """Some rows lie in the category itself: its children are not enough, so prices part it."""
    mixed = rows(100, category="m/s1") + [r | {"key": 500 + r["key"]} for r in rows(100, category="m")]
    check(Table(mixed, 50), {})


def test_out_of_reach_is_counted_and_refused(spark):
    search = Table(rows(90, price=7, category="m"), 50)
    found = sliced.plan(search, {}, 50)
    assert found.missing == 40 and len(found.leaves) == 1
    partly = sliced.plan(Table(rows(160, price=7, category="m"), 50), {"county": ["c0", "c1"]}, 50)
    assert partly.missing == 80
    with pytest.raises(ValueError, match="out of the search's reach"):
        sliced._Sliced(search, {}, ["key"], 50, 0.0, None).partitions()
    assert len(sliced._Sliced(search, {}, ["key"], 50, 1.0, None).partitions()) == 1
    with pytest.raises(ValueError, match="more than 5 searches"):
        sliced.plan(Table(rows(3000), 50), {}, 50, max_probes=5)


def test_category_graph_with_a_way_back():
    class Loop(Table):
        def __call__(self, s, page):
            a = super().__call__(s, page)
            return Answer(a.records, a.total, [("m", a.total)])

    check(Loop(rows(300, category="m"), 50), {})


def test_bands_halve_and_end():
    assert sliced.bands(None, None)[0] == (0, 100) and sliced.bands(None, None)[-1][1] is None
    assert sliced.bands(10, 20) == [(10, 15), (15, 20)] and sliced.bands(10, 11) is None
    assert sliced.bands(5, None) == [(5, 10), (10, None)]


def test_recorded_source(spark):
    search = recorded_items(spark, SMALL)
    first = search(Slice(), 1)
    assert first.total == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() and sum(n for _, n in first.children) == first.total
    assert len(first.records) == 100 and not search(Slice(), 6).records


def test_plan_of_tasks_is_the_same_and_carries_no_records(spark):
    search = recorded_items(spark, SMALL)
    here, spread = sliced.plan(search, {}), sliced.spread_plan(spark, search, {})
    assert [(s, a.total) for s, a in spread.leaves] == [(s, a.total) for s, a in here.leaves] and spread.probes == here.probes
    assert not any(a.records for _, a in spread.leaves)
    packs = sliced._Sliced(search, {}, ["external_id"], sliced.CAP, 0.0, None, spread).partitions()
    assert len(packs) < len(here.leaves) / 2 and max(sum(x.total for x in p.leaves) for p in packs) <= sliced.CAP


def test_query(spark):
    df = QUERIES["capped_scan"](spark, SMALL)
    assert_same(df, SMALL, ORACLE["capped_scan"])
    assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= sliced.CAP


def test_ranges(spark):
    assert_same(QUERIES["capped_partition_ranges"](spark, SMALL), SMALL, ORACLE["capped_partition_ranges"])


def test_a_recorded_search_reads_the_row_groups_of_its_category_and_prices(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    made = [{"key": f"{i:05}", "main": m, "category": c, "price": p, "county": f"c{i % 3}"} for i, (m, c, p) in enumerate((m, c and f"{m}/{c}", p) for m in ("a", "b", None) for c in ("x", "y", None) for p in [None] * 20 + list(range(380)))]
    (tmp_path / "recorded").mkdir()
    for n in range(2):
        pq.write_table(pa.Table.from_pylist(made[n::2]), tmp_path / "recorded" / f"part-{n}.parquet", row_group_size=50)
    search = sliced.Recorded(str(tmp_path / "recorded"), "key", 30)
    slices = [Slice(c, low, high, priced, f) for c in (None, "a", "a/x", "b/y", "zz") for low, high, priced in ((None, None, None), (None, None, False), (0, 100, True), (370, None, True), (500, None, True), (None, None, True)) for f in ((), (("county", "c1"),))]
    for s in slices:
        want = [r for r in made if s.category is None or s.category in (r["main"], r["category"])]
        want = [r for r in want if s.priced is None or (r["price"] is not None) == s.priced and (s.low is None or r["price"] >= s.low) and (s.high is None or r["price"] < s.high)]
        want = [r for r in want if all(r[n] == v for n, v in s.facets)]
        below = None if "/" in (s.category or "") else "main" if s.category is None else "category"
        children = Counter(r[below] for r in want if r[below] is not None) if below else {}
        first, asked = search(s, 1), search(s, 0)
        assert first.total == asked.total == len(want) and first.children == asked.children == sorted(children.items())
        assert [r["key"] for page in range(1, 18) for r in (search(s, page).records.to_pylist() if search(s, page).records else [])] == [r["key"] for r in want][: sliced.CAP]
    groups = sliced._groups(search.path)
    assert len(groups.rows) > 60 and 4 * len(groups.able(Slice("a/x", 100, 120, True))) < len(groups.rows)  # all of both files were read


def test_partitions_of_a_large_source_hold_many_leaves_but_no_task_grows_with_it():
    sizes = {}
    for leaves in (50, 3000, 100_000):
        found = sliced.Plan([(Slice(low=i, high=i + 1, priced=True), Answer([], 400)) for i in range(leaves)], 0, 0)
        packs = sliced._Sliced(None, {}, ["key"], 500, 0.0, None, found).partitions()
        assert [x.what.low for p in packs for x in p.leaves] == list(range(leaves))
        sizes[leaves] = (len(packs), max(sum(x.total for x in p.leaves) for p in packs))
    assert sizes[50] == (50, 400) and sizes[3000][0] < 600 and sizes[100_000][0] < 2000 and sizes[100_000][1] <= sliced.PACK * 500
