"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Spark splits each text by the tokenizer's pattern (JVM regular expression). A task gathers the distinct pieces of its
batches that it has not met yet and hands them to an in-process DuckDB as token-position rows. A recursive query joins
neighbouring tokens with the merge table, contracts each piece's minimum-rank pair, leftmost first, and repeats until
no piece has a mergeable pair. Pieces' ids then fill in the documents' id sequences. Decoding looks each id's bytes up
in the vocabulary.

Within one step all non-overlapping occurrences of a piece's minimum-rank pair contract, from the left. That equals
one contraction at a time because in a merge-ordered rank file a contraction never makes a pair of lower rank than its
own; ``ranks_are_ordered`` checks the file for it once per process, and a file that fails gets one contraction a step.

Memory: pieces enter DuckDB in chunks of ``CHUNK_BYTES``, decoding goes document by document, and the piece cache
holds about ``CACHE`` entries; DuckDB runs single-threaded without a temporary folder.

Edge cases: null and empty texts give no ids and empty bytes; special tokens' strings are ordinary text; pieces of any
length are contracted in full.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_batch, small_batches

CHUNK_BYTES = 1 << 21
CACHE = 600_000
#: Unicode white space, as the tokenizer's ``\\s`` means it (fixed values).
SPACE = r"\t-\r \x85\xA0  -     　"

#: Short pieces: one contraction a step, with g numbering all rows so that neighbours follow from one order.
SHORT_STEP = """
WITH RECURSIVE state(g, w, tok, live) AS (
    SELECT g, w, tok, true FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT g, w, tok, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS nxt, lead(g) OVER o AS g2
        FROM state WHERE live WINDOW o AS (ORDER BY g)),
    ranked AS MATERIALIZED (
        SELECT p.g, p.w, p.tok, p.g2, m.id AS rank FROM pairs p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r),
    best AS (
        SELECT w, min(rank::BIGINT * 4294967296 + g) AS pick, arg_min(g2, rank::BIGINT * 4294967296 + g) AS gone
        FROM ranked GROUP BY w)
    SELECT r.g, r.w, CASE WHEN r.g = b.pick % 4294967296 THEN r.rank ELSE r.tok END, b.pick IS NOT NULL
    FROM ranked r JOIN best b ON r.w = b.w WHERE b.gone IS NULL OR r.g <> b.gone)
)
SELECT w, tok FROM state WHERE NOT live ORDER BY g
"""
#: Long pieces: all occurrences of the minimum-rank pair that do not overlap, from the left, in one step.
LONG_STEP = """
WITH RECURSIVE state(g, w, tok, live) AS (
    SELECT g, w, tok, true FROM start
    UNION ALL
    SELECT g, w, CASE WHEN taken THEN rank ELSE tok END, best IS NOT NULL
    FROM (
        SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY g) AS gone
        FROM (
            SELECT *, best IS NOT NULL AND rank IS NOT DISTINCT FROM best AND (k - coalesce(miss, 0)) % 2 = 1 AS taken
            FROM (
                SELECT *, max(CASE WHEN rank IS DISTINCT FROM best THEN k END)
                              OVER (PARTITION BY w ORDER BY g ROWS UNBOUNDED PRECEDING) AS miss
                FROM (
                    SELECT p.*, m.id AS rank, min(m.id) OVER (PARTITION BY p.w) AS best
                    FROM (
                        SELECT g, w, tok, lead(tok) OVER (PARTITION BY w ORDER BY g) AS nxt,
                               row_number() OVER (PARTITION BY w ORDER BY g) AS k
                        FROM state WHERE live
                    ) p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r))))
    WHERE NOT gone
)
SELECT w, tok FROM state WHERE NOT live ORDER BY g
"""
#: Bytes up to which a piece is short.
SHORT = 32


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def ranks_are_ordered(ranks: dict[bytes, int]) -> bool:
    """Whether no token's own merge history ever steps down in rank."""
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            found = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if found is None:
                break
            if found[0] < last:
                return False
            last, i = found
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class Coder:
    """One process's DuckDB with the merge table and the vocabulary, and the pieces met so far."""

    def __init__(self, path: str) -> None:
        import duckdb

        ranks = load_ranks(path)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        l, r, i = (pa.array([m[k] for m in merges], pa.int32()) for k in range(3))  # noqa: E741
        table = pa.table({"l": l, "r": r, "id": i})
        self.con.register("merges_in", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.names = {r: str(r).encode() for r in ranks.values()}
        self.long_step = LONG_STEP if ranks_are_ordered(ranks) else SHORT_STEP
        self.whole = ranks
        self.known: dict[str, np.ndarray] = {}
        self.before: dict[str, np.ndarray] = {}

    def _contract(self, pieces: list[bytes], step: str) -> list[np.ndarray]:
        sizes = np.array([len(b) for b in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        start = pa.table({"g": pa.array(np.arange(len(flat), dtype=np.int64)), "w": pa.array(w), "tok": pa.array(self.byte_ids[flat])})
        self.con.register("start", start)
        got = self.con.execute(step).fetchnumpy()
        self.con.unregister("start")
        ends = np.searchsorted(np.asarray(got["w"]), np.arange(len(pieces)), side="right")
        return np.split(np.asarray(got["tok"]).astype(np.int32), ends[:-1])

    def learn(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each of the distinct pieces. The cache has two generations: a full one becomes the old one, and what
        is met again moves on, so that frequent pieces stay."""
        ids = [self.known.get(p) for p in pieces]
        missing = []
        for i, p in enumerate(pieces):
            if ids[i] is None:
                if (old := self.before.get(p)) is not None:
                    ids[i] = self.known[p] = old
                elif (whole := self.whole.get(raw := p.encode())) is not None:  # a piece that is a token is that token
                    ids[i] = self.known[p] = np.array([whole], np.int32)
                else:
                    missing.append((len(raw), i, raw))
        missing.sort(key=lambda m: m[0])
        at = 0
        while at < len(missing):
            step = SHORT_STEP if missing[at][0] <= SHORT else self.long_step
            size, end = 0, at
            while end < len(missing) and size < CHUNK_BYTES and (missing[end][0] <= SHORT) == (missing[at][0] <= SHORT):
                size += missing[end][0]
                end += 1
            for (_, i, _), found in zip(missing[at:end], self._contract([m[2] for m in missing[at:end]], step)):
                ids[i] = self.known[pieces[i]] = found
            at = end
        if len(self.known) > CACHE // 2:
            self.before, self.known = self.known, {}
        return ids

    def encode(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and where each document's end."""
        offsets = pieces.offsets.to_numpy()
        coded = pieces.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = self.learn(words)
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        first = sizes.cumsum() - sizes
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = lengths.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(first[at], lengths)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        return flat[take], bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each document of an id sequence."""
        return [b"".join(map(self.bytes_of.__getitem__, ids[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]

    def spelt(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each document's ids in decimal, by commas."""
        return [b",".join(map(self.names.__getitem__, ids[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern for Java: its Unicode white space spelt out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")


def pieces(text_col: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = coder(path).encode(batch.column("p"))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return _split(docs, pattern, id_col, text_col).mapInArrow(per_batch(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) per row of (id, ids)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("ids")
        offsets = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(coder(path).decode(ids, offsets - offsets[0]), pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(per_batch(run), "id long, bytes binary").withColumnRenamed("id", id_col)


def coding_report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encodes, then decodes the ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        ids, bounds = c.encode(batch.column("p"))
        digests = [hashlib.sha256(x).hexdigest() for x in c.spelt(ids, bounds)]
        back = [hashlib.sha256(x).hexdigest() for x in c.decode(ids, bounds)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(digests, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = _split(docs, pattern, id_col, text_col).mapInArrow(per_batch(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("id", id_col)


def _split(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).alias("id"), pieces(text_col, pattern).alias("p"))
