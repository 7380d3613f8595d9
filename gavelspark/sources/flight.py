"""Decoder of row streams ``id:JSON`` and ``id:T<hex length>,<text>`` with ``$id`` references between rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def read_rows(payload: str) -> dict[str, object]:
    """Rows by id. Lengths of text rows count bytes; lines that are neither kind are passed over."""
    data, at, rows = payload.encode(), 0, {}
    while at < len(data):
        colon = data.find(b":", at)
        line_end = data.find(b"\n", at)
        line_end = len(data) if line_end < 0 else line_end
        if colon < 0 or colon > line_end:
            at = line_end + 1
            continue
        key = data[at:colon].decode(errors="replace")
        comma = data.find(b",", colon)
        if data[colon + 1 : colon + 2] == b"T" and comma > 0 and all(c in b"0123456789abcdef" for c in data[colon + 2 : comma]) and comma > colon + 2:
            size = int(data[colon + 2 : comma], 16)
            rows[key] = data[comma + 1 : comma + 1 + size].decode(errors="replace")
            at = comma + 1 + size
            continue
        try:
            rows[key] = json.loads(data[colon + 1 : line_end])
        except ValueError:
            pass
        at = line_end + 1
    return rows


def resolve(value: object, rows: dict[str, object], open_: frozenset[str] = frozenset()) -> object:
    """``value`` with references replaced by their rows; a reference to a row that is being resolved gives None."""
    if isinstance(value, str) and value.startswith("$") and len(value) > 1:
        key = value[1:].lstrip("L@")
        if key in open_:
            return None
        return resolve(rows[key], rows, open_ | {key}) if key in rows else value
    if isinstance(value, list):
        return [resolve(v, rows, open_) for v in value]
    if isinstance(value, dict):
        return {k: resolve(v, rows, open_) for k, v in value.items()}
    return value


def objects_with(value: object, field: str) -> Iterator[dict]:
    """All objects in ``value`` that have a field, outermost first."""
    if isinstance(value, dict):
        if field in value:
            yield value
            return
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            yield from objects_with(v, field)


def decode(payloads: DataFrame, field: str, key: str = "key", col: str = "payload") -> DataFrame:
    """(key, object as JSON) for every object with ``field`` in the payloads; to be parsed with from_json."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, payload in zip(batch[key], batch[col]):
                rows = read_rows(payload or "")
                met: set[str] = set()
                for row in rows.values():
                    for found in objects_with(resolve(row, rows), field):
                        text = json.dumps(found, ensure_ascii=False, sort_keys=True)
                        if text not in met:
                            met.add(text)
                            out.append((k, text))
            yield pd.DataFrame(out, columns=["key", "object"])

    return payloads.select(key, col).mapInPandas(run, "key string, object string")
