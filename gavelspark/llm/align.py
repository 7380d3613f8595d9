"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece model (B) cover the same bytes.

A batch's texts lie end to end in one byte space. The ends of A's tokens are one packed bitset over it, those of B's
another. Their AND holds the cuts that both share, which bound the groups; popcounts of whole words, summed up, give
the rank of a cut in either bitset, that is the range of tokens each group takes. Their OR cuts the bytes into the
smallest segments: each lies in one token of A and in one of B, and two tokens that overlap share exactly one segment,
so segments are links and the ranks before a segment's end name its two tokens.

How often a pair of ids is linked in the whole corpus is a sum over all documents. Pairs that hold more than one in
``HOT`` links are fewer than ``HOT`` whatever the input, so their counts are broadcast (17 bytes each); what documents
hold of all rarer pairs meets its counts in a shuffle.

Where neither side can join a space to what stands before it (a byte-level split at white space; pieces with a space
only in front), texts are cut there and each distinct piece is tokenized once and remembered, which gives the same ids.
Other tokenizers get whole texts.

Edge cases: texts that are null or empty, and those whose tokens do not give back a space and the text (a piece model
may normalise), have no tokens and all-zero results; special tokens' strings are ordinary text; rows with equal or null
ids count apart; other columns are not looked at.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, per_batch, small_batches

HOT = 1_000_000
#: Characters of the texts that are aligned at a time; a longer text is aligned alone.
CHUNK = 1 << 20
#: Pieces that a process remembers, and the longest that it does.
REMEMBERED, LONGEST = 800_000, 100
_SPACED = re.compile(r" [^ ]*")
#: A space behind what may be white space to a tokenizer.
_RUN = re.compile(r"[^!-~\w] | $")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the
    other bytes take the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@contextmanager
def _uncollected() -> Iterator[None]:
    """Many small objects without cycles are made here; the collector would walk over all that is remembered again and
    again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@dataclass
class Bits:
    """A bitset in 64-bit words with running popcounts."""

    words: np.ndarray

    def __post_init__(self) -> None:
        self.before = np.concatenate([[0], np.bitwise_count(self.words).astype(np.int64).cumsum()])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Texts end to end. ``a`` and ``b`` are token ids; document d has tokens ``a_doc[d]`` to ``a_doc[d + 1]`` of A and
    so on; group g ends before token ``a_cut[g]`` of A and ``b_cut[g]`` of B; link k joins tokens ``a_link[k]`` and
    ``b_link[k]``."""

    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    group_doc: np.ndarray
    link_doc: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars, vocabulary = byte_of_char(), self.first.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        size = self.second.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i in range(size) for p in [self.second.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Each id in decimal with what follows it: of A inside a group and at the end of its A part, of B likewise.
        self.signs = [f"{i}{mark}" for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(t))]
        self.local = self._local(json.loads(self.first.to_str()))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}

    def _local(self, form: dict) -> bool:
        """Whether both tokenizers end a token before every space that follows something else than white space."""
        split = form["pre_tokenizer"] or {}
        first = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and form["normalizer"] is None and all(t["special"] for t in form["added_tokens"])
        odd = "a  b\t\n ﬁ½ é\u0301 ＡⅣ \u00a0 "
        second = all("▁" not in self.second.id_to_piece(i).lstrip("▁") for i in range(self.second.get_piece_size())) and self.second.normalize(odd).replace("▁", " ") == " " + odd
        return bool(first and second)

    def pieces(self, full: str) -> list[str]:
        """``full``, which begins with a space, cut before spaces that follow a letter, a digit or ASCII punctuation."""
        if not self.local:
            return [full]
        parts = _SPACED.findall(full)
        if not _RUN.search(full):
            return parts
        out: list[str] = []
        open_ = False  # whether the last piece may go on
        for p in parts:
            if open_:
                out[-1] += p
            else:
                out.append(p)
            open_ = _RUN.match(p[-1] + " ") is not None
        if len(out) > 1 and out[-1] == " ":
            out[-2:] = [out[-2] + " "]
        return out

    def _tokenized(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of A and of B for each piece, as four bytes each; None where the bytes of either are not the piece's."""
        firsts = self.first.encode_batch_fast(pieces, add_special_tokens=False)
        seconds = self.second.encode([p[1:] for p in pieces], num_threads=1)  # it adds the space
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        out: dict[str, tuple[bytes, bytes] | None] = {}
        for p, x, y in zip(pieces, firsts, seconds):
            raw, ids = p.encode(), x.ids
            same = b"".join(map(of_a, ids)) == raw and b"".join(map(of_b, y)) == raw
            out[p] = (array("I", ids).tobytes(), array("I", y).tobytes()) if same else None
        return out

    def tokens(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B end to end, and where each text's begin and end; none where the bytes of either are not a
        space and the text. What was met lately is remembered in two generations."""
        cut = [self.pieces(" " + t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        self.known.update((p, self.before[p]) for p in new.intersection(self.before))
        missing = new.difference(self.known)
        found = self._tokenized(sorted(missing)) if missing else {}
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        known = self.known | found if any(len(p) > LONGEST for p in found) else self.known
        a: list[bytes] = []
        b: list[bytes] = []
        for pieces in cut:
            ids = [known[p] for p in pieces]
            a.append(b"" if None in ids else b"".join([i[0] for i in ids]))
            b.append(b"" if None in ids else b"".join([i[1] for i in ids]))
        if len(self.known) > REMEMBERED // 2:
            self.before, self.known = self.known, {}
        return tuple((np.frombuffer(b"".join(side), np.uint32).astype(np.int64), np.cumsum([0, *map(len, side)]) // 4) for side in (a, b))

    def align(self, texts: list[str | None]) -> Aligned:
        with _uncollected():
            (a, a_doc), (b, b_doc) = self.tokens(texts)
        a_end, b_end = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        size = int(a_end[-1]) if len(a_end) else 0
        doc_end = np.concatenate([[0], a_end])[a_doc[1:]]  # where each document's bytes end
        in_a, in_b = Bits.at(a_end - 1, size), Bits.at(b_end - 1, size)
        shared, either = Bits(in_a.words & in_b.words).select(), Bits(in_a.words | in_b.words).select()
        return Aligned(
            a, b, in_a.rank(shared) + 1, in_b.rank(shared) + 1, in_a.rank(either), in_b.rank(either), a_doc, b_doc,
            np.concatenate([[0], np.searchsorted(shared, doc_end)]), np.concatenate([[0], np.searchsorted(either, doc_end)]),
        )

    def spelt(self, x: Aligned) -> list[str]:
        """Each document's groups as text: ids of A by commas, a bar, ids of B, groups by semicolons."""
        a_sizes, b_sizes = np.diff(x.a_cut, prepend=0), np.diff(x.b_cut, prepend=0)
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        # a group's tokens of A stand behind all earlier ones of B, those of B behind all of A up to the group's end
        a_last, b_last = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        a_last[x.a_cut - 1] = b_last[x.b_cut - 1] = 1
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        codes[np.arange(len(x.a)) + np.repeat(x.b_cut - b_sizes, a_sizes)] = x.a + n_a * a_last
        codes[np.arange(len(x.b)) + np.repeat(x.a_cut, b_sizes)] = 2 * n_a + x.b + n_b * b_last
        ends = x.a_doc + x.b_doc
        return ["".join(map(self.signs.__getitem__, codes[p:q].tolist()))[:-1] for p, q in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield first, k
            first, size = k, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _within(values: np.ndarray, per_doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places over a whole batch as places inside their document."""
    return values - np.repeat(starts, np.diff(per_doc))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``a_ids``, ``b_ids``, ``a_cuts`` and ``b_cuts`` (group g ends before these tokens of the row), and
    ``a_links`` and ``b_links`` (places in ``a_ids`` and ``b_ids`` of the two tokens of each link, in byte order)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, c = batch.column("text").to_pylist(), aligner(path_a, path_b)
        for first, last in _chunks(texts):
            x = c.align(texts[first:last])
            cuts = [_within(v, x.group_doc, s[:-1]) for v, s in ((x.a_cut, x.a_doc), (x.b_cut, x.b_doc))]
            links = [_within(v, x.link_doc, s[:-1]) for v, s in ((x.a_link, x.a_doc), (x.b_link, x.b_doc))]
            columns = [_lists(x.a, x.a_doc, pa.int32()), _lists(x.b, x.b_doc, pa.int32()), *(_lists(v, x.group_doc, pa.int32()) for v in cuts), *(_lists(v, x.link_doc, pa.int32()) for v in links)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), *columns], names=["id", "a_ids", "b_ids", "a_cuts", "b_cuts", "a_links", "b_links"])

    schema = "id long, " + ", ".join(f"{n} array<int>" for n in ("a_ids", "b_ids", "a_cuts", "b_cuts", "a_links", "b_links"))
    rows = small_batches(docs, 200).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(per_batch(run), schema).withColumnRenamed("id", id_col)


def _digests(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Per row its counts, the digest of its groups and its linked pairs (A id * 2^20 + B id) with their numbers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, c = batch.column("text").to_pylist(), aligner(path_a, path_b)
        for first, last in _chunks(texts):
            x = c.align(texts[first:last])
            pair = (x.a[x.a_link] << 20) | x.b[x.b_link]
            doc = np.repeat(np.arange(last - first), np.diff(x.link_doc))
            order = np.lexsort((pair, doc))
            pair, doc = pair[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(pair)))
            bounds = np.searchsorted(doc[new], np.arange(last - first + 1))
            digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in c.spelt(x)]
            counts = [pa.array(np.diff(v)) for v in (x.a_doc, x.b_doc, x.group_doc, x.link_doc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(first, last - first), *counts, pa.array(digest, pa.string()), _lists(pair[new], bounds, pa.int64()), _lists(times, bounds, pa.int32())],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    schema = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = small_batches(docs, 200).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(per_batch(run), schema).withColumn("__row", F.monotonically_increasing_id())


def pair_counts(digests: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus: how many links hold the pair, and whether no pair of its B id has more."""
    met = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    met = durable(met, "pairs").withColumn("b", F.col("pair").bitwiseAND((1 << 20) - 1))
    top = met.groupBy("b").agg(F.max("count").alias("most"))  # one row for each id of B
    return met.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row: tokens of either side, groups
    between shared cuts, links, how many of the links are of a pair that is its B id's most frequent in the corpus,
    and the sum of the links' corpus-wide counts."""
    spark = docs.sparkSession
    rows = durable(_digests(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs = durable(pair_counts(rows), "counts")
    total = pairs.agg(F.sum("count")).first()[0] or 0
    limit = total // hot
    frequent = pairs.filter(F.col("count") > limit).toArrow()  # fewer than ``hot`` rows, as each has over total/hot links
    key, count, best = (frequent.column(n).to_numpy() for n in ("pair", "count", "best"))
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((key[order], count[order], best[order]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, count, best = known.value
        lists = batch.column("pairs")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        pair = lists.values.to_numpy()[bounds[0] : bounds[-1]]
        times = batch.column("times").values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64)
        bounds = bounds - bounds[0]
        at = np.minimum(np.searchsorted(key, pair), max(len(key) - 1, 0))
        held = key[at] == pair if len(key) else np.zeros(len(pair), bool)
        gain = np.zeros((2, len(pair)), np.int64)
        gain[0, held], gain[1, held] = times[held] * best[at[held]], times[held] * count[at[held]]
        sums = np.concatenate([np.zeros((2, 1), np.int64), gain.cumsum(axis=1)], axis=1)[:, bounds]
        left = np.concatenate([[0], (~held).cumsum()])[bounds]
        return pa.RecordBatch.from_arrays([batch.column("__row"), *(pa.array(np.diff(s)) for s in sums), _lists(pair[~held], left, pa.int64()), _lists(times[~held], left, pa.int32())], names=["__row", "n_best", "count_sum", "pairs", "times"])

    scored = small_batches(rows, 1000).select("__row", "pairs", "times").mapInArrow(per_batch(run), "__row long, n_best long, count_sum long, pairs array<long>, times array<int>")
    scored = durable(scored, "scored")
    rare = scored.filter(F.size("pairs") > 0).select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rare.join(pairs.filter(F.col("count") <= limit), "pair").select("__row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    sums = scored.select("__row", "n_best", "count_sum").union(rest).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "__row").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
