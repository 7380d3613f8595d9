"""The pipeline against a brute-force version of its stages, and each stage on edge rows."""

import re

import pytest

from gavelspark.llm import langid
from gavelspark.llm.common import durable

from ..support import SMALL
from .fixtures import CLASHES, EDGE, documents, empty
from .test_line_dedup import brute as brute_lines
from .test_packing import check
from .test_secrets import KEYS, TRICKY, brute as brute_secrets, without
from .test_simhash import brute_components, brute_print

pipeline = pytest.importorskip("corpus_pipeline")


#: What counts as a secret, in Python's own dialect: base kinds with their least lengths, then the added ones.
ADDED = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\s\\-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,})*)",
    "gh[opsu]_[A-Za-z0-9]{36}", "AIza[0-9A-Za-z_-]{35}", "xox[abprs]-[A-Za-z0-9-]{10,}", "[rs]k_live_[A-Za-z0-9]{16,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
]


def masked(text):
    spans = [(s, e) for s, _, _, e in brute_secrets(text)] + [m.span() for p in ADDED for m in re.finditer(p, text, re.A)]
    return without(text, spans)


def brute(rows, model):
    """The rows after language ID, line dedup, near-dedup and masking."""
    names, scores = model.predict([t for _, t in rows])
    rows = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= model.threshold]
    rows = [(i, kept) for i, _, _, kept in brute_lines(rows)]
    of = brute_components([i for i, _ in rows], [brute_print(t) for _, t in rows])
    return [(i, masked(t)) for (i, t), c in zip(rows, of) if i == c]


SECRETS = [(900_000 + k, f"Row number {k} of prose with words of its own like w{k}a w{k}b w{k}c and then {secret} and the text goes on for a while so that it is kept {k}", "en", "planted") for k, secret in enumerate([*(x[1] for x in TRICKY[:7]), *(x[1] for x in KEYS)])]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The tables' documents and rows with secrets of every kind: ids, texts and word counts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    planted = spark.createDataFrame(SECRETS, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(d.doc_id, d.text) for d in docs.collect()], langid.learn(docs))
    assert len({i for i, _ in want} & {r[0] for r in SECRETS}) >= 8
    texts = docs
    for name, stage in pipeline.STAGES[:-1]:
        texts = durable(stage(spark, texts, str(tmp_path)), name)
    assert sorted((r.doc_id, r.text) for r in texts.collect()) == sorted(want)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(t.split())) for i, t in want)
    check(got)


def test_stages_on_edge_rows(spark):
    docs = documents(spark, clashes=True)
    model_docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*pipeline.COLUMNS)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == pipeline.COLUMNS, name
        assert stage(spark, empty(spark), SMALL).count() == 0
        assert got.count() <= len(EDGE)
    both = pipeline.STAGES[0][1](spark, model_docs.unionByName(docs.select(*pipeline.COLUMNS)), SMALL)
    kept = {r.text for r in both.collect()}
    assert None not in kept and "" not in kept
    assert set(CLASHES) & set(docs.columns)
    assert pipeline.STAGES[-1][1](spark, empty(spark), SMALL).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(EDGE)


def test_counts_follow_the_text(spark):
    for name in ("line_dedup", "secret_scans"):
        got = dict(pipeline.STAGES)[name](spark, documents(spark), SMALL)
        assert got.filter("NOT (n_chars <=> length(text))").count() == 0
