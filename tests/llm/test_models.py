"""Language ID, toxicity and quality rules: held-out accuracy, definitions by brute force, edge rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gavelspark.llm import langid, quality, queries, toxicity

from ..support import MIDDLE
from .fixtures import EDGE, documents, empty


def test_folds(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), langid.in_fold(5, 0).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if d.lang and d.text and got[d.doc_id].held_out]
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert sum(got[d.doc_id].rejected for d in held) <= 0.02 * len(held)


def test_language_edges(spark):
    model = langid.learn(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    got = langid.identify(documents(spark, clashes=True), model)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    for text in (None, "", " \t\n\x0b "):
        match = [r for (_, t), r in rows.items() if t == text]
        assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in match) and match
    assert got.count() == len(EDGE)
    nothing = langid.learn(empty(spark))
    assert {r.lang_pred for r in langid.identify(documents(spark), nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def gram_list(text):
    raw = b" " + text.lower().encode() + b" "
    two = [raw[i] << 8 | raw[i + 1] for i in range(len(raw) - 1)]
    three = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] | 1 << 24 for i in range(len(raw) - 2)]
    return Counter((g * 2654435761 % (1 << 32)) >> 18 for g in two + three)


def test_gram_counts_equal_brute_force(monkeypatch):
    texts = ["", "a", "Åäö 東京", "the cat sat on the mat " * 30]
    for chunk in (langid.CHUNK, 1, 2, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for t in texts:
            counts = langid.gram_counts(t)
            assert {int(b): int(counts[b]) for b in np.nonzero(counts)[0]} == gram_list(t)


def test_every_language_is_learned(spark):
    """More languages than any fixed list; ids that repeat under several of them."""
    rng = np.random.default_rng(5)
    vocabulary = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(12)] for k in range(80)}
    rows = [(100 * k + i, " ".join(rng.choice(words, 30)), lang) for k, (lang, words) in enumerate(vocabulary.items()) for i in range(12)]
    rows += [(7, f"same id number {i}", "zz" if i % 2 else "aa") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.langs == sorted({r[2] for r in rows})
    got = langid.identify(docs.filter("doc_id != 7"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_near_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        hits, you = (sorted(set(rng.integers(0, 60, rng.integers(0, 12)).tolist())) for _ in range(2))
        assert toxicity._near(hits, you) == sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits)
    assert toxicity._near(list(range(0, 10**6, 2)), list(range(1, 10**6, 2))) == 5 * 10**5


def test_features_of_a_very_long_text():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"idio": 1.0})
    x = dict(zip(toxicity.FEATURES, lexicon.features("you idiot and more words " * 200_000)))
    assert x["near_you"] == x["word_hits"] == x["stem_hits"] == 200_000 and x["you_rate"] == 0.2


def test_toxicity_with_repeated_ids(spark):
    rows = [(i % 40, f"you {'fool' if i % 2 else 'friend'} number {i}", None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    got = toxicity.score(docs, toxicity.learn(docs, labels, max_labelled=30)).collect()
    assert len(got) == 400 and all(r.predicted == r.doc_id % 2 for r in got)


def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    held = [i for i in labels if got[i].held_out]
    score, y = np.array([got[i].score for i in held]), np.array([labels[i] for i in held])
    ranks = score.argsort().argsort()
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc >= 0.97
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.96 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_edges(spark):
    docs = documents(spark, clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, none)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, one)).collect()} == {1.0}
    both = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, both)).count() == len(EDGE)
    assert toxicity.score(empty(spark), model).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all() and 0 <= p[0] <= p[-1] <= 1


def brute_stats(text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words = [w for w in "".join(" " if c in spaces else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(spaces)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


def test_statistics_equal_brute_force(spark):
    rows = queries.QUERIES["op4_quality_rules"](spark, MIDDLE).collect()
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_quality_of_labelled_documents(spark):
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op4_quality_rules"](spark, MIDDLE).collect()}
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()
    clean = [kept[r.doc_id] for r in labels if r.quality == 1]
    assert sum(clean) >= 0.95 * len(clean)


def test_quality_of_held_out_documents(spark):
    """Rules learned from four fifths of the labels, judged on the rest."""
    sf_dir = "/root/testdata/sf0.1"
    labels, held = spark.read.parquet(f"{sf_dir}/labels.parquet"), langid.in_fold(5, 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels.filter(~held)).collect()}
    rows = labels.filter(held).groupBy("doc_id").agg(F.min("quality").alias("quality")).collect()
    clean, bad = ([kept[r.doc_id] for r in rows if r.quality == q] for q in (1, 0))
    assert len(clean) > 50 and len(bad) > 50
    assert sum(clean) >= 0.95 * len(clean) and sum(bad) <= 0.06 * len(bad), (sum(clean), len(clean), sum(bad), len(bad))


def test_repeats_in_long_texts(monkeypatch):
    words = [f"w{i % 50}".encode() for i in range(200)] + [f"x{i}".encode() for i in range(100)]
    short = quality.repeated_words(words)
    monkeypatch.setattr(quality, "LONG", 10)
    assert quality.repeated_words(words) == short == 200


def test_quality_edges(spark):
    docs = documents(spark, clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, none)
    want = sorted(((x[0], *brute_stats(x[1])) for x in EDGE if len(x[1] or "") < 10_000), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect() if r.doc_id != 4), key=repr) == want
    assert all(r.kept != r.base_failed for r in got.collect())
    assert quality.judge(empty(spark), none).count() == 0


def test_decision_list_finds_planted_rules(spark):
    rng = np.random.default_rng(1)
    x = {"n_words": rng.integers(10, 500, 3000).astype(float), "upper_share": rng.random(3000), "marks_per_word": rng.random(3000)}
    bad = (x["upper_share"] > 0.8) | ((x["n_words"] <= 60) & (x["marks_per_word"] > 0.5))
    rules = quality.learn_list(x, bad)
    hit = np.logical_or.reduce([quality._covers(r, x) for r in rules])
    assert (hit == bad).mean() > 0.97
    assert all(len(r) <= quality.MAX_CONDITIONS for r in rules)
    row = spark.createDataFrame([(200, 1000, 900, 0, 1)], "n_words long, word_chars long, n_upper long, n_marks long, n_lines long")
    assert not row.select(quality.verdict(rules).alias("kept")).first().kept
