"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are computed once. A bounded sample of labelled rows (``MAX_LABELLED``, the rows of
least hash) teaches an ordered list by sequential covering: a rule that condemns grows one threshold at a time by
information gain on two thirds of the rows, is pruned on the last third, and is kept only while it is right on at least
``PRECISION`` of the pruning rows it covers; the rows it covers then leave. The list becomes one ordered Spark
conditional expression, so applying it is plain column arithmetic.

Edge cases: null and empty texts have no words and fail the base rule; a document without labels is judged like any
other; repeated or conflicting labels count as the lower one; with no labels, or one class only, the list is empty and
only the base rule decides.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, per_batch, small_batches

#: Bound on the labelled rows the list is learned from.
MAX_LABELLED = 20_000
PRECISION = 0.95
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_WORDS = 10
REPEAT_PERCENT = 20
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Texts of more words than this count their windows in numpy instead of in a dictionary of tuples.
LONG = 100_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
FEATURES = {
    "n_words": lambda c: c("n_words"),
    "chars_per_word": lambda c: c("word_chars") / c("n_words"),
    "symbols_per_word": lambda c: c("n_symbols") / c("n_words"),
    "dup_line_share": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeat_share": lambda c: c("n_repeat_words") / c("n_words"),
    "upper_share": lambda c: c("n_upper") / c("word_chars"),
    "marks_per_word": lambda c: c("n_marks") / c("n_words"),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) > LONG:
        ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1].astype(np.int64)
        grams = ids
        for k in range(1, window):
            pair = grams[: len(ids) - k] * (int(ids.max()) + 1) + ids[k:]
            grams = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        twice = np.bincount(grams)[grams] > 1
    else:
        grams = list(zip(*(words[i : n + i] for i in range(window))))
        if len(set(grams)) == n:
            return 0
        counts = Counter(grams)
        twice = np.fromiter((counts[g] > 1 for g in grams), bool, n)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((edges.cumsum() > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    bare = raw.translate(None, SPACES)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(bare)),
        len(bare) - len(bare.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(bare) - len(bare.translate(None, b"!?")),
    )


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the columns of ``STATS``) per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_stats(t) for t in batch.column("t").to_pylist()], np.int64).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(rows[:, i]) for i in range(len(STATS))], names=["id", *STATS])

    done = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(per_batch(run), "id long, " + ", ".join(f"{s} long" for s in STATS))
    return done.withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature as a double; 0 where its divisor is 0."""
    return F.coalesce(FEATURES[name](lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.value if self.above else x[self.name] <= self.value

    def column(self) -> Column:
        return feature(self.name) > self.value if self.above else feature(self.name) <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(next(iter(x.values()))), bool)


def _best_cut(values: np.ndarray, bad: np.ndarray) -> tuple[float, bool, float]:
    """(gain, above, threshold) of the best threshold; of those about as good, the one in the widest gap, so that a
    threshold stands clear of the rows on both sides."""
    order = np.argsort(values, kind="stable")
    v, p = values[order], np.concatenate([[0], bad[order].cumsum()])
    cuts = np.nonzero(v[1:] > v[:-1])[0] + 1
    if not len(cuts):
        return 0.0, True, 0.0
    best = (0.0, True, 0.0)
    before = np.log2(p[-1] / len(v))
    for above in (True, False):
        hits = p[-1] - p[cuts] if above else p[cuts]
        rows = len(v) - cuts if above else cuts
        gain = np.where(hits > 0, hits * (np.log2(np.maximum(hits, 1) / rows) - before), 0.0)
        if gain.max() > best[0]:
            close = np.nonzero(gain >= 0.97 * gain.max())[0]
            at = cuts[close[np.argmax(v[cuts[close]] - v[cuts[close] - 1])]]
            best = (float(gain.max()), above, float((v[at] + v[at - 1]) / 2))
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
        (gain, above, value), name = max((_best_cut(v[inside], bad[inside]), n) for n, v in x.items())
        if gain <= 0:
            break
        rule += (Condition(name, above, value),)
        inside &= rule[-1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    best: tuple[float, Rule] = (-2.0, rule)
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], x)
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k])
    hit = _covers(best[1], x)
    return best[1], float(bad[hit].mean()) if hit.any() else 0.0, int(hit.sum())


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules that condemn; rows are split into growing and pruning thirds by position."""
    rules: list[Rule] = []
    turn = np.arange(len(bad)) % 3
    live = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = live & (turn > 0), live & (turn == 0)
        if bad[grow].sum() < MIN_COVER or bad[grow].all():
            break
        take = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grow(take(grow), bad[grow])
        if not rule:
            break
        rule, precision, cover = _prune(rule, take(prune), bad[prune])
        if cover < MIN_COVER or precision < PRECISION:
            break
        rules.append(rule)
        live &= ~_covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression of a list: false at the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    tests = [[c.column() for c in rule] for rule in rules]
    out = None
    for conditions in tests:
        held = conditions[0]
        for c in conditions[1:]:
            held = held & c
        out = F.when(held, False) if out is None else out.when(held, False)
    return out.otherwise(True)


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    known = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    rows = stats.join(F.broadcast(sample), id_col).filter(~base_failed()).select(id_col, "quality", *[feature(f).alias("f_" + f) for f in FEATURES])
    rows = rows.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled).toPandas()
    if rows["quality"].nunique() < 2:
        return []
    return learn_list({f: rows["f_" + f].to_numpy() for f in FEATURES}, (rows["quality"] == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, statistics, base_failed, kept) per row."""
    stats = durable(with_stats(docs, id_col, text_col), "stats")
    rules = learn_from(stats, labels, id_col, max_labelled)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
