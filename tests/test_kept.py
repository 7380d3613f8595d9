"""Kept tables, the kept trigram index and saved searches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gavelspark.functions.vectors import trigram_similarity
from gavelspark.operators import merge as M
from gavelspark.operators import saved
from gavelspark.operators.gram_index import GramIndex
from gavelspark.operators.kept import Conflict, KeptTable
from gavelspark.plans.adapt import ntz
from gavelspark.plans.queries import ORACLE, QUERIES
from gavelspark.plans.queries_kept import saved_searches

from .support import SMALL, assert_same


@pytest.mark.parametrize("name", ["item_merge_kept", "bid_refresh_kept", "finalize_history_kept", "history_fuzzy_kept", "fuzzy_join_kept", "saved_searches_all", "saved_searches_newest"])
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), SMALL, ORACLE[name])


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v long")


def total(now, new):
    return M.merge(now, new, ["k"], {"v": M.add})


def got(df):
    return sorted((r.k, r.v) for r in df.collect())


@pytest.fixture
def kept(spark, tmp_path):
    return KeptTable.create(str(tmp_path / "kept"), rows(spark, [(k, 0) for k in range(200)]), ["k"], 16)


def test_a_batch_rewrites_only_its_buckets(spark, kept):
    before = kept.files()
    touched = {r.b for r in rows(spark, [(3, 0), (7, 0)]).select(kept._bucket(kept.version()).alias("b")).collect()}
    kept.merge(rows(spark, [(3, 5), (7, 1)]), total)
    after = kept.files()
    assert len(before) == 16 and {b for b in before if before[b] != after[b]} == touched
    assert got(kept.read()) == [(k, {3: 5, 7: 1}.get(k, 0)) for k in range(200)]
    assert got(kept.read(1)) == [(k, 0) for k in range(200)]  # a reader of the old version


def test_reading_keys_reads_their_buckets(spark, kept):
    asked = rows(spark, [(3, 0)])
    near = kept.read(keys=asked)
    assert 0 < near.count() < 60 and got(near.filter("k = 3")) == [(3, 0)]


def test_log_then_settle(spark, kept):
    kept.log(rows(spark, [(3, 5), (500, 1)]))
    kept.log(rows(spark, [(3, 2)]))
    want = sorted([(k, 7 if k == 3 else 0) for k in range(200)] + [(500, 1)])
    assert got(kept.read()) == [(k, 0) for k in range(200)] and got(kept.read(settle=total)) == want
    assert got(kept.read(keys=rows(spark, [(500, 0)]), settle=total).filter("k = 500")) == [(500, 1)]
    before = kept.files()
    kept.settle(total)
    assert got(kept.read()) == want and not kept.version().log
    assert sum(before[b] != f for b, f in kept.files().items() if b in before) <= 2


def test_two_writers_cannot_both_win(spark, kept):
    late = kept.version()
    kept.merge(rows(spark, [(1, 1)]), total)
    with pytest.raises(Conflict):
        kept._commit(late, late.__class__(late.number + 1, late.key, late.buckets, late.schema))
    assert got(kept.read())[1] == (1, 1)


def test_a_writer_that_died_leaves_no_version(spark, kept, tmp_path):
    (tmp_path / "kept" / "versions" / "0000000009.json").write_text('{"number": 9')
    assert kept.version().number == 1


def test_rows_of_other_buckets_are_refused(spark, kept):
    with pytest.raises(ValueError, match="does not touch"):
        kept.merge(rows(spark, [(1, 1)]), lambda now, new: rows(spark, [(k, 0) for k in range(50)]))


def test_deletes_appends_compaction_and_vacuum(spark, kept):
    kept.merge(rows(spark, [(k, 0) for k in range(100)]), lambda now, new: now.join(new.select("k"), "k", "left_anti"))
    for k in range(3):
        kept.append(rows(spark, [(1000 + k, k)] * 3), spread=2)
    want = sorted([(k, 0) for k in range(100, 200)] + [(1000 + k, k) for k in range(3)] * 3)
    assert got(kept.read()) == want
    kept.compact(0)
    assert got(kept.read()) == want and all(len(g) == 1 for g in kept.version().parts.values())
    old = kept.version().number - 1
    assert kept.vacuum(1) > 0 and got(kept.read()) == want
    with pytest.raises(Exception):
        kept.read(old).collect()


def test_empty_table_and_empty_batch(spark, tmp_path):
    kept = KeptTable.create(str(tmp_path / "empty"), rows(spark, []), ["k"], 4)
    assert got(kept.read()) == []
    kept.merge(rows(spark, []), total)
    kept.log(rows(spark, []))
    kept.merge(rows(spark, [(1, 2)]), total)
    assert got(kept.read()) == [(1, 2)]


TITLES = ["Volvo V70 kombi", "Volvo V70 kombi 2008", "guldring 18k", "guldringar", "Åkgräsklippare", "x", "", "!!", "soffa i skinn", "Soffa, skinn"]


@pytest.fixture
def titles(spark):
    return lambda *t: spark.createDataFrame([(x,) for x in t], "title string")


def searched(index, text, threshold):
    return sorted((r.text, round(r.similarity, 9)) for r in index.search(text, threshold).collect())


def test_index_and_additions_equal_a_rebuilt_one(spark, tmp_path, titles):
    parts = GramIndex.build(str(tmp_path / "parts"), titles(*TITLES[:4]), 8)
    opened = GramIndex(spark, str(tmp_path / "parts"))
    more = parts.add(titles(*TITLES[3:7])).compact(1).add(titles(*TITLES, *TITLES))
    whole = GramIndex.build(str(tmp_path / "whole"), titles(*TITLES), 8)
    for text in ("volvo v70", "guldring", "soffa skinn", "åkgräsklippare", "zzz", "!!"):
        want = sorted((t, s) for t in TITLES for s in [similarity(spark, t, text)] if s >= 0.3)
        assert searched(more, text, 0.3) == searched(whole, text, 0.3) == want
    assert {r.text for r in opened.search("soffa skinn", 0.1).collect()} == set()  # an older reader sees what was there
    asked = titles("volvo v70 kombi 2009", "guldringen 18k", "soffa skinn", "!!")
    pairs = lambda i: sorted((r.a, r.b, round(r.similarity, 9)) for r in i.similar(asked, 0.45).collect())
    want = sorted((a, b, s) for a in ("volvo v70 kombi 2009", "guldringen 18k", "soffa skinn", "!!") for b in TITLES for s in [similarity(spark, a, b)] if s >= 0.45)
    assert pairs(more) == pairs(whole) == want
    assert sorted(r.n for r in more.freq.read().collect()) == sorted(r.n for r in whole.freq.read().collect())


def similarity(spark, a, b):
    return round(spark.range(1).select(trigram_similarity(F.lit(a), F.lit(b)).alias("s")).first().s, 9)


def test_containing(spark, tmp_path, titles):
    index = GramIndex.build(str(tmp_path / "i"), titles(*TITLES), 4)
    found = lambda part: sorted(r.text for r in index.containing(part).collect())
    for part in ("VOLVO", "ring", "gräs", "v7", "i skinn", "70 kombi", "zzz", "a, s"):
        assert found(part) == sorted(t for t in TITLES if part.lower() in t.lower()), part


ITEMS = "house string, external_id string, title string, category string, location string, price long, insolvency boolean, first_seen timestamp_ntz"
SEARCHES = "search long, words array<string>, houses array<string>, category string, place string, low long, high long, insolvent boolean, last_checked timestamp_ntz"


def day(n):
    return datetime(2024, 1, n)


def matched(spark, items, searches, **kw):
    df = saved.match_saved(spark.createDataFrame(items, ITEMS), spark.createDataFrame(searches, SEARCHES), ntz("2024-01-20 00:00:00"), **kw)
    return sorted((r.search, r.external_id) for r in df.collect())


def test_conditions_of_saved_searches(spark):
    items = [
        ("a", "1", "Volvo V70 kombi", "fordon/bil", "Göteborg", 5000, True, day(5)),
        ("b", "2", "Guldring 18k", "smycken", "København", 0, False, day(6)),
        ("a", "3", None, None, None, None, None, day(7)),
        ("c", "4", "xy", "fordon", "Malmö", 1 << 40, False, day(25)),
        ("c", "5", "volvoverktyg", "fordonsdelar", "1.5 km", 64, False, day(10)),
    ]
    none = (None,) * 8
    at = lambda **kw: tuple(kw.get(f.split()[0]) for f in SEARCHES.split(", ")[1:])
    searches = [
        (1, *none), (2, *at(words=["volvo"])), (3, *at(words=["volvo", "kombi"])), (4, *at(words=["v7"])), (5, *at(category="fordon")), (6, *at(houses=["b", "c"])),
        (7, *at(place="Köpenhamn")), (8, *at(low=64, high=5000)), (9, *at(low=0)), (10, *at(insolvent=True)), (11, *at(last_checked=day(6))), (12, *at(words=["zeppelin"])), (13, *at(high=63)),
        (14, *at(low=100, high=10)), (15, *at(words=[], houses=[])), (16, *at(place="1.5")), (17, *at(words=["volvo"], houses=["c"], category="fordonsdelar", low=1)),
    ]
    seen = ["1", "2", "3", "5"]
    want = {1: seen, 2: ["1", "5"], 3: ["1"], 4: ["1"], 5: ["1"], 6: ["2", "5"], 8: ["1", "5"], 9: ["1", "2", "5"], 10: ["1"], 11: ["3", "5"], 13: ["2"], 15: seen, 16: ["5"], 17: ["5"]}
    found = matched(spark, items, searches)
    assert [x for x in found if x[0] != 7] == [(s, i) for s in sorted(want) for i in want[s]]
    assert [x for x in found if x[0] == 7] in ([], [(7, "2")])  # whichever spellings the table knows
    assert matched(spark, [], searches) == [] and matched(spark, items, []) == []


def test_limit_takes_the_newest_of_a_search_that_meets_everything(spark):
    items = [("h", f"{n:04}", "t", None, None, None, None, datetime(2024, 1, 1 + n % 15, n % 24)) for n in range(900)]
    found = matched(spark, items, [(1, *(None,) * 8)], limit=5)
    best = sorted(items, key=lambda i: (-i[7].timestamp(), i[0], i[1]))[:5]
    assert [x[1] for x in found] == sorted(i[1] for i in best)


def test_a_search_that_has_found_enough_does_not_meet_older_items(spark, monkeypatch):
    for name, n in (("FIRST", 2), ("GROWTH", 2), ("BY_ROW", 40), ("ITEM_BLOCK", 16), ("SEARCH_BLOCK", 3)):
        monkeypatch.setattr(saved, name, n)
    met, paired = [], saved._paired
    monkeypatch.setattr(saved, "_paired", lambda rows, asked: met.append(paired(rows, asked).count()) or paired(rows, asked))
    items = [(("h", None)[n % 7 == 3], f"{n:04}", f"lot {n % 50}", None, f"Ort {n % 4}", n, None, datetime(2024, 1, 1 + n % 15, n % 5)) for n in range(600)]
    none = (None,) * 8
    searches = [(i, *none) for i in range(10)] + [(20, ["lot", "49"], *none[1:]), (21, *none[:3], "ort 2", *none[4:]), (22, *none[:4], 590, *none[5:]), (23, *none[:3], "nowhere", *none[4:])]
    newest = sorted(items, key=lambda i: (-i[7].timestamp(), i[0] or "", i[1]))
    fits = {20: lambda i: i[2] == "lot 49", 21: lambda i: i[4] == "Ort 2", 22: lambda i: i[5] >= 590, 23: lambda i: False}
    want = sorted((s[0], i[1]) for s in searches for i in [i for i in newest if fits.get(s[0], lambda i: True)(i)][:5])
    assert matched(spark, items, searches, limit=5) == want
    assert len(met) > 4 and sum(met) < 2500  # ten searches without a condition would meet 6,000
    assert len(matched(spark, items, searches, limit=None)) == 10 * 600 + 12 + 150 + 10


def test_pair_work_is_far_below_rows_times_searches(spark):
    items, searches = saved_searches(spark, SMALL)
    new = items.filter("ends_at > '1999-12-01' AND ends_at <= '2000-06-01'")
    met, matches = saved.candidates(new, searches, "ends_at").count(), QUERIES["saved_searches_all"](spark, SMALL).count()
    everything = new.count() * searches.count()
    assert matches <= met < everything / 5, (matches, met, everything)


def fits(s, i):
    """Whether an item meets a search, written from the conditions as they are told."""
    _, words, houses, category, place, low, high, insolvent, last = s
    house, _, title, cat, location, price, insolvency, seen = i
    return (
        (last is None or seen > last) and (low is None or (price is not None and price >= low)) and (high is None or (price is not None and price <= high)) and (not insolvent or insolvency is True)
        and (not houses or (house is not None and house in houses)) and (category is None or (cat is not None and (cat == category or cat.startswith(category + "/")))) and (place is None or (location is not None and place.lower() in location.lower()))
        and (not words or (title is not None and all(w is not None and w in title.lower() for w in words)))
    )


def test_blocks_of_any_size_find_what_a_loop_finds(spark, monkeypatch):
    import random

    r = random.Random(4)
    some = lambda *x: r.choice((None, *x))
    items = [(some("a", "b"), str(n), some("Röd RING", "stor ring 18k", "kugghjul", "x"), some("c", "c/d", "cd"), some("Ort 1", "ort 2", "Annan"), some(0, 5, 63, 64, 1 << 40, -3), some(True, False), datetime(2024, 1, 1 + r.randrange(19), r.randrange(3))) for n in range(300)]
    searches = [(n, some(["ring"], ["ring", "röd"], [], ["18k", None], ["kugg"]), some(["a"], ["b", None], [], [None], ["a", "b"]), some("c", "c/d"), some("ort", "annan", "nirgends"), some(0, 5, 70, -5), some(63, 64, 1 << 41), some(True, False), some(day(3), day(12))) for n in range(150)]
    want = {s[0]: sorted((i for i in items if fits(s, i)), key=lambda i: (-i[7].timestamp(), i[0] or "", i[1])) for s in searches}
    for size in ((16, 30, 100, 3), (8192, 4096, 65_536, 64)):
        for name, n in zip(("ITEM_BLOCK", "SEARCH_BLOCK", "BY_ROW", "CUTS"), size):
            monkeypatch.setattr(saved, name, n)
        assert matched(spark, items, searches, limit=None) == sorted((s, i[1]) for s, found in want.items() for i in found)
        assert matched(spark, items, searches, limit=4) == sorted((s, i[1]) for s, found in want.items() for i in found[:4])


def test_all_finds_are_made_without_a_shuffle_of_pairs(spark):
    plan = QUERIES["saved_searches_all"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # items and searches of a key were copied through one


def test_newest_finds_keep_no_more_than_is_asked_for(spark, monkeypatch):
    sizes, pinned = [], saved.pinned

    def counted(df):
        df = pinned(df)
        sizes.append(df.count())
        return df

    monkeypatch.setattr(saved, "pinned", counted)
    items = [("h", f"{n:04}", "t", None, None, None, None, datetime(2024, 1, 1 + n % 15, n % 24)) for n in range(900)]
    assert len(matched(spark, items, [(k, *(None,) * 8) for k in range(50)], limit=5)) == 250
    assert max(sizes) <= 900  # all finds of a slab were written down, 64 times as many as are asked for at most


def test_large_buckets_are_made_and_merged_in_steps(spark, tmp_path, monkeypatch):
    from gavelspark.operators import kept as K

    monkeypatch.setattr(K, "STEP", 1)
    table = KeptTable.create(str(tmp_path / "kept"), rows(spark, [(k, 0) for k in range(200)]), ["k"], 8, steps=3)
    assert got(table.read()) == [(k, 0) for k in range(200)] and len(table.files()) == 8
    seen = []

    def add(now, new):
        seen.append((now.count(), new.count()))
        return total(now, new)

    table.merge(rows(spark, [(k, 1) for k in range(0, 260, 2)]), add)
    assert got(table.read()) == sorted([(k, int(k % 2 == 0)) for k in range(200)] + [(k, 1) for k in range(200, 260, 2)])
    assert len(seen) == 8 and [sum(n) for n in zip(*seen)] == [200, 130]  # all buckets were rewritten in one shuffle
    assert not list(tmp_path.glob("kept/batch-*"))
    with pytest.raises(ValueError, match="does not touch"):
        table.merge(rows(spark, [(1, 1)]), lambda now, new: rows(spark, [(k, 0) for k in range(50)]))


def test_the_refresh_leaves_the_files_of_one_version(spark, tmp_path, monkeypatch):
    from gavelspark.plans import queries_kept as Q

    monkeypatch.setattr(Q, "shared_path", lambda spark, tag: str(tmp_path / tag))
    monkeypatch.setattr(Q, "LOTS_A_STEP", 4000)
    assert_same(QUERIES["bid_refresh_kept"](spark, SMALL), SMALL, ORACLE["bid_refresh_kept"])
    assert len(list(tmp_path.glob("kept/versions/*.json"))) == 1  # there were three, each with all rows
    assert len(list(tmp_path.glob("kept/data/*"))) == 1 and not list(tmp_path.glob("kept/batch-*"))
