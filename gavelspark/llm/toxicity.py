"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

From a bounded sample of labelled rows (``MAX_LABELLED``, those of least id hash) two lexicons are learned by log-odds,
one of whole words and one of word beginnings; the classic insults need no list of their own. Dense features of a text
are: lexicon densities and counts, second-person words near lexicon hits, capitals, marks, digits and symbols, and
obfuscation (letters swapped for look-alikes or broken by symbols, folded back and looked up). Histogram trees are
boosted on the features in numpy. The curve that makes the score a probability (pool adjacent violators) is fitted on
scores from outside: for each of ``FOLDS`` folds of the ids, lexicons and trees are learned from the other folds only.

Edge cases: null and empty texts have all-zero features and get the calibrated score of that point; with no labels, or
one class only, every score is the share of toxic labels (0 with none); repeated labels of a row count as toxic if one
of them is; of rows that share an id one (that of least text hash) is learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, per_batch, small_batches

#: Bound on the labelled rows that the lexicons and trees are learned from.
MAX_LABELLED = 20_000
WORDS, STEMS, STEM_LENGTHS = 512, 512, (4, 5, 6, 7, 8)
MIN_DOCS = 5
TREES, DEPTH, RATE, BINS, FOLDS = 80, 3, 0.15, 48, 3
EDGE_MARKS = "\"'`.,;:!?()[]{}<>#*$%&|_-~^+=/\\"
#: Second-person words (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos ti tus usted ustedes vosotros".split())
#: Look-alike characters and the letters they stand for (fixed values).
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")
_BROKEN = re.compile(r"[^\W\d_]+(?:[@$!|*0-9._\-]+[^\W\d_]+)+|[^\W\d_]*[@$!|0-9][^\W\d_]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
FEATURES = ["word_hits", "word_density", "word_weight", "stem_hits", "stem_density", "stem_weight", "hidden_hits", "hidden_density", "broken_rate", "near_you", "you_rate", "upper_share", "mark_rate", "symbol_rate", "digit_rate", "log_words"]
NEAR = 5
#: Words whose stems a task remembers at most.
SEEN = 200_000


def split_words(text: str) -> list[str]:
    return [w for w in (x.strip(EDGE_MARKS) for x in text.lower().split()) if w]


def _near(hits: list[int], you: list[int]) -> int:
    """Hits with a second-person word at most ``NEAR`` words away; both lists ascend."""
    if not hits or not you:
        return 0
    at = np.array(hits)
    first = np.searchsorted(you, at - NEAR)
    return int((first < np.searchsorted(you, at + NEAR, side="right")).sum())


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    seen: dict[str, float | None] = field(default_factory=dict, repr=False, compare=False)

    def features(self, text: str | None) -> tuple[float, ...]:
        if not text:
            return (0.0,) * len(FEATURES)
        words = split_words(text)
        n = max(len(words), 1)
        hits = [i for i, w in enumerate(words) if w in self.words]
        found = [x for x in map(self._stem, words) if x is not None]
        stems, stem_weight = len(found), sum(found)
        # a match never spans white space, and needs a letter after a mark
        broken = [b for w in text.split() if not (x := w.rstrip(EDGE_MARKS)).isalpha() for b in _BROKEN.findall(x)]
        hidden = sum(1 for b in broken if self._folded(b))
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = _near(hits, you)
        raw = text.encode()
        size = len(raw)
        count = lambda chars: size - len(raw.translate(None, chars))
        return (
            len(hits), len(hits) / n, sum(self.words[words[i]] for i in hits),
            stems, stems / n, stem_weight / n,
            hidden, hidden / n, len(broken) / n,
            near, len(you) / n,
            count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, count(b"!?") / size, count(b"#*$%&|<>@") / size, count(b"0123456789") / size,
            float(np.log1p(n)),
        )

    def _stem(self, word: str) -> float | None:
        """Weight of the shortest known beginning; what recent words gave is remembered."""
        if word not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[word] = next((x for k in STEM_LENGTHS if len(word) >= k and (x := self.stems.get(word[:k])) is not None), None)
        return self.seen[word]

    def _folded(self, piece: str) -> bool:
        low = piece.lower()
        return any(_NOT_LETTER.sub("", x) in self.words for x in (low.translate(LOOK_ALIKE), low))


@dataclass
class Tree:
    """A complete tree: node i tests feature[i] <= cut[i] and goes to 2i+1, else 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.cut[node])
        return self.value[node - (2**DEPTH - 1)]


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> Tree:
    inner = 2**DEPTH - 1
    tree = Tree(np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**DEPTH))
    node = np.zeros(len(x), int)
    for i in range(inner):
        at = np.nonzero(node == i)[0]
        if len(at) > 2 * MIN_DOCS:
            g, h = grad[at].sum(), hess[at].sum()
            best = 1e-3
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.bincount(codes[at, f], grad[at], len(c) + 1).cumsum()[:-1]
                hl = np.bincount(codes[at, f], hess[at], len(c) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < 0.5) | (h - hl < 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, tree.feature[i], tree.cut[i] = gain[k], f, c[k]
        node[at] = 2 * i + 1 + (x[at, tree.feature[i]] > tree.cut[i])
    for leaf in range(2**DEPTH):
        at = node == leaf + inner
        tree.value[leaf] = -RATE * grad[at].sum() / (hess[at].sum() + 1)
    return tree


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(rate / (1 - rate))), [])
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mids = (v[1:] + v[:-1]) / 2
        cuts.append(mids if len(mids) <= BINS else np.unique(np.quantile(mids, np.linspace(0, 1, BINS))))
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _tree(x, codes, cuts, p - y, p * (1 - p))
        model.trees.append(tree)
        raw += tree.predict(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of scores
    for s, t in zip(score[order], y[order]):
        blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        if not texts:
            return np.zeros(0)
        x = np.array([self.lexicon.features(t) for t in texts], float)
        return np.interp(self.trees.raw(x), *self.knots)


def _terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct terms of each text: =word for words, ^stem for beginnings; with the row's label and fold."""
    out, label, fold = [], [], []
    for t, y, f in zip(*(batch.column(c).to_pylist() for c in ("t", "y", "fold"))):
        words = set(split_words(t or ""))
        terms = {"=" + w for w in words} | {"^" + w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k}
        out += terms
        label += [y] * len(terms)
        fold += [f] * len(terms)
    return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32()), pa.array(fold, pa.int32())], names=["term", "y", "fold"])


def _learn_lexicons(sample: DataFrame, rows: dict[tuple[int, int], int]) -> list[Lexicon]:
    """A lexicon without each fold, then one of all rows; ``rows``: number of rows by (fold, label)."""
    of = lambda k, y: F.count(F.when((F.col("fold") == k) & (F.col("y") == y), True))
    terms = small_batches(sample).select("t", "y", "fold").mapInArrow(per_batch(_terms), "term string, y int, fold int")
    counts = terms.groupBy("term").agg(*[of(k, y).alias(f"n{k}{y}") for k in range(FOLDS) for y in (0, 1)])
    counts = durable(counts.filter(sum((F.col(f"n{k}1") for k in range(FOLDS)), F.lit(0)) >= MIN_DOCS), "terms")
    lexicons = []
    for left_out in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != left_out]
        total = [sum(rows.get((k, y), 0) for k in folds) for y in (0, 1)]
        p = (sum((F.col(f"n{k}1") for k in folds), F.lit(0)) + 0.5) / (total[1] + 1)
        q = (sum((F.col(f"n{k}0") for k in folds), F.lit(0)) + 0.5) / (total[0] + 1)
        found = sum((F.col(f"n{k}1") for k in folds), F.lit(0))
        scored = counts.filter(found >= MIN_DOCS).withColumn("w", F.log(p / q)).filter("w > 1.2").withColumn("use", found * F.col("w"))
        lexicon = Lexicon()
        for sign, kept, limit in (("=", lexicon.words, WORDS), ("^", lexicon.stems, STEMS)):
            for r in scored.filter(F.col("term").startswith(sign)).orderBy(F.desc("use"), "term").limit(limit).collect():
                kept[r.term[1:]] = r.w
        lexicons.append(lexicon)
    return lexicons


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        known = known.filter(train)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(known), "id")
    # one text for an id that repeats, so that the sample keeps its bound
    sample = texts.groupBy("id", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    sample = durable(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")), "labelled")
    rows = {(r.fold, r.y): r.n for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = {y for _, y in rows}
    if len(seen) < 2:
        return ToxicityModel(Lexicon(), None, None, float(1 in seen))
    lexicons = _learn_lexicons(sample, rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t").to_pylist()
        x = [pa.array([list(map(float, lexicon.features(t))) for t in texts], pa.list_(pa.float64())) for lexicon in lexicons]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), *x], names=["id", "y", "fold", *(f"x{k}" for k in range(len(x)))])

    schema = "id long, y int, fold int, " + ", ".join(f"x{k} array<double>" for k in range(len(lexicons)))
    rows = small_batches(sample).mapInArrow(per_batch(run), schema).toArrow().sort_by("id")
    x = [rows.column(f"x{k}").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) for k in range(len(lexicons))]
    y, fold = rows.column("y").to_numpy().astype(float), rows.column("fold").to_numpy()
    outside = np.empty(len(y))
    for k in range(FOLDS):
        outside[fold == k] = boost(x[k][fold != k], y[fold != k]).raw(x[k][fold == k])
    return ToxicityModel(lexicons[-1], boost(x[-1], y), isotonic(outside, y), float(y.mean()))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(batch.column("t").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    done = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(per_batch(run), "id long, score double, predicted int")
    return done.withColumnRenamed("id", id_col)
