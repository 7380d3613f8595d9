import hashlib

import pytest

from gavelspark.llm import line_dedup, queries

from ..support import MIDDLE, SMALL, assert_same
from .fixtures import CLASHES, EDGE, documents, empty

INF = 1 << 62


def brute(rows):
    """Kept lines of each row, by the definition."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), INF), INF if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (INF if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_sql(spark, sf_dir):
    assert_same(queries.QUERIES["op5_line_dedup"](spark, sf_dir), sf_dir, queries.OP5_SQL)


def test_edge_rows(spark):
    got = sorted(map(tuple, line_dedup.line_report(documents(spark, clashes=True)).collect()), key=repr)
    want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(EDGE)), key=repr)
    assert got == want


def test_texts_and_columns_survive(spark):
    docs = documents(spark, clashes=True)
    got = line_dedup.dedup_lines(docs)
    assert got.schema.names == docs.schema.names
    rows = got.collect()
    assert all(r[c] == "mine" for r in rows for c in CLASHES)
    null_stays = [(i, None if text is None else kept) for (i, text, *_), (_, _, _, kept) in zip(EDGE, brute(EDGE))]
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(null_stays, key=repr)


def test_hot_key_across_partitions(spark):
    rows = [(i, f"the very common line\nown line of {i}", None, None) for i in range(400)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(documents(spark, rows)).collect()}
    assert got == {i: int(i > 0) for i in range(400)}


def test_bitmap_round_trip():
    keep = line_dedup.unpack_bitmap(line_dedup._bitmap([1, 17, 18]), 30)
    assert [i for i, k in enumerate(keep) if not k] == [1, 17, 18]
    assert line_dedup.unpack_bitmap(None, 3).all()


def test_empty_table(spark):
    assert line_dedup.line_report(empty(spark)).count() == 0
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
