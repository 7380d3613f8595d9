"""Comparing Spark results with DuckDB's over the same Parquet tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(value):
    """A value that compares the same from either engine; doubles to nine significant digits."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def assert_same(df, sf_dir: str, sql: str) -> None:
    columns, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    assert len(ours) == len(theirs), f"{len(ours)} rows, the oracle has {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, f"{len(wrong)} of {len(ours)} rows differ, the first: {wrong[0]}"
