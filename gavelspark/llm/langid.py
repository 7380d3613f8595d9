"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average embedding of its hashed byte bigrams and trigrams (lower-cased), followed by a linear layer. Both
are trained with stochastic gradient descent in numpy on a bounded sample: at most ``PER_LANG`` texts of each language,
those of least id hash, and at most ``MAX_TEXTS`` in all, shared evenly by the languages. Every language of the labels
is learned. As the model is linear in the gram counts, applying it needs one table of ``BUCKETS`` rows, which is all
that goes to the executors.

The softmax is calibrated by a temperature on rows left out of training, and the rejection threshold is the score that
``REJECT`` of those rows stay under, but never above one half: rejected texts are those that look like no learned
language.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and are rejected; with no labelled row at
all every text is ``und``; ties go to the language that sorts first; of rows that share an id and a language one (that
of least text hash) is learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable, per_batch, small_batches

#: Bounds on the training sample: texts of a language, and of all languages.
PER_LANG = 1500
MAX_TEXTS = 96_000
BUCKETS = 1 << 14
DIM = 16
#: Gradient steps, of ``BATCH`` rows each: so many, or so many for each language, whatever the size of the sample.
STEPS, STEPS_PER_LANG, BATCH = 1000, 100, 32
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 18
REJECT = 0.001
UND = "und"
_MIX = np.uint32(2654435761)


def gram_counts(text: str) -> np.ndarray:
    """How many hashed byte bigrams and trigrams of the lower-cased text, with a space at both ends, fall into each
    bucket. A text of any length takes one array of ``BUCKETS`` counts."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw) - 1, CHUNK):
        a = raw[start : start + CHUNK + 2].astype(np.uint32)
        two = a[:-1] << np.uint32(8) | a[1:]
        three = two[:-1] << np.uint32(8) | a[2:] | np.uint32(1 << 24)
        both = np.concatenate([two[:CHUNK], three[:CHUNK]])
        counts += np.bincount((both * _MIX) >> np.uint32(32 - 14), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        scores, names = np.zeros(len(texts)), [UND] * len(texts)
        if not self.langs:
            return names, scores
        logits = np.zeros((len(texts), len(self.langs)))
        letters = [has_letter(t) for t in texts]
        for i, t in enumerate(texts):
            if letters[i]:
                counts = gram_counts(t)
                held = np.nonzero(counts)[0]
                logits[i] = counts[held] @ self.table[held] / counts.sum() + self.bias
        p = softmax(logits)
        for i in np.nonzero(letters)[0]:
            k = int(p[i].argmax())
            names[i], scores[i] = self.langs[k], p[i, k]
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Histograms:
    """(bucket, count) lists of many texts, end to end in small integers: the sample lies in the driver's memory."""

    buckets: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text ``i`` and their shares."""
        at = slice(self.offsets[i], self.offsets[i + 1])
        counts = self.counts[at].astype(float)
        return self.buckets[at].astype(np.int64), counts / counts.sum()

    def mean(self, i: int, table: np.ndarray) -> np.ndarray:
        buckets, shares = self[i]
        return shares @ table[buckets]


def fit(hists: Histograms, order: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 3) -> LanguageModel:
    """``order``: the texts to learn from; ``y``: their languages, in that order. A fifth of them calibrates."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    hold = np.arange(len(y)) % 5 == 4
    train = np.nonzero(~hold)[0]
    steps = max(STEPS, STEPS_PER_LANG * len(langs))
    for step in range(steps if len(train) else 0):
        rate = 1.0 * (1 - step / steps)
        batch = rng.choice(train, BATCH)
        mean = np.stack([hists.mean(order[i], emb) for i in batch])
        error = softmax(mean @ out + bias)
        error[np.arange(BATCH), y[batch]] -= 1
        error /= BATCH
        back = error @ out.T
        out -= rate * mean.T @ error
        bias -= rate * error.sum(axis=0)
        for i, g in zip(batch, back):
            buckets, shares = hists[order[i]]
            emb[buckets] -= (rate * BATCH) * shares[:, None] * g
    table = emb @ out
    z = np.stack([hists.mean(order[i], table) + bias for i in np.nonzero(hold)[0]]) if hold.any() else np.zeros((0, len(langs)))
    scale, threshold = 1.0, 0.0
    if len(z):
        t = y[hold]
        # smoothed targets: left-out rows without an error still leave room for one
        target = np.full(z.shape, 1 / (len(t) + 2) / max(len(langs) - 1, 1))
        target[np.arange(len(t)), t] = 1 - 1 / (len(t) + 2)
        losses = {s: -(target * np.log(softmax(z * s) + 1e-12)).sum(axis=1).mean() for s in np.geomspace(0.05, 8, 61)}
        scale = float(min(losses, key=losses.get))
        threshold = float(min(0.5, np.quantile(softmax(z * scale).max(axis=1), REJECT)))
    return LanguageModel(langs, (table * scale).astype(np.float32), bias * scale, threshold)


def in_fold(mod: int, rest: int, id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod ``mod`` is ``rest``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, per_lang: int = PER_LANG) -> LanguageModel:
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        rows = rows.filter(train)
    counts = rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()
    langs = [r.l for r in counts]
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    per_lang = max(1, min(per_lang, MAX_TEXTS // len(langs)))
    # hashes are even: those under a share of their range hold about twice the rows to take, and only they are ranked
    range_ = 1 << 20
    spark = docs.sparkSession
    shares = F.broadcast(spark.createDataFrame([(r.l, int(range_ * min(1.0, (2 * per_lang + 100) / r.n))) for r in counts], "l string, share long"))
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("l"), F.xxhash64(id_col).alias("h")).join(shares, "l")
    ids = ids.filter(F.pmod("h", F.lit(range_)) <= F.col("share")).select("id", "l", "h").distinct()
    least = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(range_)), "h", "id")
    ids = ids.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= per_lang).select("id", "l")
    ids = F.broadcast(durable(ids, "sample"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [gram_counts(t) for t in batch.column("t").to_pylist()]
        held = [np.nonzero(c)[0] for c in counts]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("l"), pa.array([h.astype(np.int16) for h in held], pa.list_(pa.int16())), pa.array([c[h].astype(np.int32) for c, h in zip(counts, held)], pa.list_(pa.int32()))],
            names=["id", "l", "b", "c"],
        )

    sample = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).join(ids, ["id", "l"])
    # one text for an id that repeats, so that the sample keeps its bound
    sample = sample.groupBy("id", "l").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    got = small_batches(sample).mapInArrow(per_batch(run), "id long, l string, b array<smallint>, c array<int>").toArrow().combine_chunks()
    ids_, b, c = (got.column(n).chunk(0) if got.num_rows else pa.array([], got.schema.field(n).type) for n in ("id", "b", "c"))
    labels = got.column("l").to_pylist()
    order = np.lexsort([np.array(labels, str), ids_.to_numpy()])
    order = order[np.random.default_rng(1).permutation(len(order))]
    hists = Histograms(b.values.to_numpy(), c.values.to_numpy(), b.offsets.to_numpy().astype(np.int64))
    number = {l: k for k, l in enumerate(langs)}
    model = fit(hists, order, np.array([number[labels[i]] for i in order], int), langs)
    del got, hists, b, c, ids_
    pa.default_memory_pool().release_unused()
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of a caller under these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        names, scores = m.predict(batch.column(text_col).to_pylist())
        rejected = [n == UND or s < m.threshold for n, s in zip(names, scores)]
        new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
        return pa.RecordBatch.from_arrays(list(batch.columns) + new, names=batch.schema.names + ["lang_pred", "score", "rejected"])

    plain = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema] + ["lang_pred string, score double, rejected boolean"])
    return small_batches(plain).mapInArrow(per_batch(run), schema)
