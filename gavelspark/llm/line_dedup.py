"""Exact line deduplication over a corpus.

Every line's key (ends stripped of ASCII white space, A-Z lower-cased) is reduced to 128 hash bits. One range
partitioning on (hash, document, position) with the sort of that order inside each partition puts a key's lines next
to each other in document order, and lets a key that holds a third of the corpus run across many partitions. A
streaming pass keeps only the current key and the document that opened it, and emits just the *dropped* lines. The
lines that a partition's first document contributes to its first key stay undecided until the one summary row a
partition gives for its first and last key says whether an earlier partition opened that key. What comes back is one
compressed bitmap per document that loses lines; texts are never shuffled to find them.

Edge cases: null and empty texts are one empty line; keys under ``min_chars`` code points are never dropped; lines
that repeat inside the document that keeps them stay; rows sharing a doc_id count as one document; rows with a null
doc_id count as one document that comes last.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ID, RK, WHITE, ascii_lower, aside, durable, keyed, per_batch, shuffle_width, small_batches, with_columns

MIN_CHARS = 10
_DROP, _OPEN, _EDGE = 0, 1, 2
KEEP = "__keep"


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, __id, __rk, pos) for each line whose key is long enough."""
    lines = keyed(docs, id_col, text_col).select(ID, RK, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(WHITE)))
    return lines.select(ID, RK, "pos", key.alias("key")).filter(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), ID, RK, "pos")


def _stream(batches):
    """Over one sorted range partition: dropped lines, undecided lines of the first key, a summary of both ends."""
    prev = None  # (h1, h2, first id) of the key at hand
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, rk, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        n = len(h1)
        start = np.empty(n, bool)
        start[0] = prev is None or prev[0] != h1[0] or prev[1] != h2[0]
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
        first = np.where(at >= 0, ids[np.maximum(at, 0)], 0 if prev is None else prev[2])
        if head is None:
            head = (h1[0], h2[0], ids[0])
        prev = (h1[-1], h2[-1], first[-1])
        kind = np.where(ids != first, _DROP, np.where((h1 == head[0]) & (h2 == head[1]), _OPEN, -1)).astype(np.int8)
        take = kind >= 0
        if take.any():
            yield pa.RecordBatch.from_arrays([pa.array(kind[take])] + [pa.array(x[take]) for x in (h1, h2, ids, rk, pos)], names=["kind", "h1", "h2", ID, RK, "pos"])
    if head is not None:
        ends = list({head, tuple(prev)})
        yield pa.RecordBatch.from_arrays(
            [pa.array([_EDGE] * len(ends), pa.int8())] + [pa.array([int(e[i]) for e in ends], pa.int64()) for i in range(3)] + [pa.array([0] * len(ends), pa.int64()), pa.array([0] * len(ends), pa.int32())],
            names=["kind", "h1", "h2", ID, RK, "pos"],
        )


def _bitmap(positions: list[int]) -> bytes:
    """Little-endian bits, 1 = keep, up to the byte of the last dropped line, compressed; all later lines stay."""
    bits = np.ones(-(-(max(positions) + 1) // 8) * 8, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def unpack_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(__id, __rk, keep_bitmap) for each document that loses a line."""
    n = shuffle_width(docs.sparkSession)
    order = ["h1", "h2", ID, RK, "pos"]
    # written first: the range partitioning reads its input twice, to sample it and to deal it
    hashes = durable(line_hashes(docs, id_col, text_col, min_chars), "hashes")
    ranged = hashes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = durable(ranged.mapInArrow(_stream, f"kind tinyint, h1 long, h2 long, {ID} long, {RK} long, pos int"), "lines")
    opened = marked.filter(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.min(ID).alias("first"))
    late = marked.filter(F.col("kind") == _OPEN).join(opened, ["h1", "h2"]).filter(F.col(ID) > F.col("first"))
    drops = marked.filter(F.col("kind") == _DROP).select(ID, RK, "pos").union(late.select(ID, RK, "pos"))
    lists = drops.groupBy(ID, RK).agg(F.collect_set("pos").alias("pos"))
    return lists.mapInArrow(
        per_batch(lambda b: with_columns(b, ["pos"], keep_bitmap=pa.array([_bitmap(p) for p in b.column("pos").to_pylist()], pa.binary()))),
        f"{ID} long, {RK} long, keep_bitmap binary",
    )


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__keep``, the row's bitmap (null: every line stays)."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars).withColumnRenamed("keep_bitmap", KEEP)
    return keyed(docs, id_col, text_col).join(maps, [ID, RK], "left")


def _kept(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    text = text or ""
    if bitmap is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    keep = unpack_bitmap(bitmap, len(lines))
    return len(lines), int((~keep).sum()), "\n".join(x for x, k in zip(lines, keep) if k)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the surviving lines as text (null stays null); other columns as they were."""
    docs, back = aside(docs, ID, RK, KEEP)
    names = docs.columns

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, maps = batch.column(text_col), batch.column(KEEP)
        if maps.null_count < len(maps):
            texts = pa.array([t if m is None else _kept(t, m)[2] for t, m in zip(texts.to_pylist(), maps.to_pylist())], pa.string())
        return pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(n) for n in names], names=names)

    joined = with_bitmaps(docs, id_col, text_col, min_chars)
    return back(small_batches(joined).select(*[F.col(f"`{c}`") for c in names], KEEP).mapInArrow(per_batch(apply), docs.schema))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) for each document, from the bitmaps."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [_kept(t, m) for t, m in zip(batch.column("t").to_pylist(), batch.column(KEEP).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string())],
            names=[id_col, "n_lines", "n_dropped", "kept_sha256"],
        )

    rows = small_batches(with_bitmaps(docs.select(id_col, text_col), id_col, text_col, min_chars)).select(id_col, F.col(text_col).alias("t"), KEEP)
    return rows.mapInArrow(per_batch(digest), f"{id_col} long, n_lines long, n_dropped long, kept_sha256 string")
