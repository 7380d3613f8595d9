import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from gavelspark.llm import bpe, queries

from ..support import MIDDLE, SMALL
from .fixtures import EDGE, documents, empty

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoder(path=PATH):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(rows):
    enc = encoder()
    out = []
    for i, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(tuple, queries.QUERIES["op10_byte_bpe"](spark, sf_dir).collect()), key=repr) == want([(d.doc_id, d.text) for d in docs])


def test_edge_and_odd_texts(spark):
    r = random.Random(4)
    spaces = "\t\n\x0b\x0c\r \x1c\x1f\x85\xa0   ​    　﻿"
    pool = spaces + "abcxyz'stdmlv0123٣½éßλжה東🎉👩‍👧.,!-_" + "́\x00\x7f"
    odd = [(100 + i, "".join(r.choice(pool) for _ in range(r.randint(1, 80))), None, None) for i in range(300)]
    odd += [(500, "a" * 5000, None, None), (501, "=" * 3001, None, None), (502, "ab" * 1500 + "<|endoftext|>", None, None), (503, " " * 700 + "x", None, None)]
    rows = EDGE + odd
    got = bpe.coding_report(documents(spark, rows, clashes=True), PATH, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == want([(x[0], x[1]) for x in rows])


def test_ids_and_bytes(spark):
    docs = documents(spark, EDGE[:4])
    ids = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    enc = encoder()
    assert {r.doc_id: r.ids for r in ids.collect()} == {x[0]: enc.encode_ordinary(x[1] or "") for x in EDGE[:4]}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, PATH).collect()} == {x[0]: (x[1] or "").encode() for x in EDGE[:4]}


def test_unordered_ranks_fall_back(spark, tmp_path):
    """Tokens that are ranked before their own parts, and one that no contraction reaches: the library's ids still."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300, b"aba": 258, b"ba": 299, b"bab": 260, b"cab": 259, b"ca": 301, b"ccc": 302}
    assert not bpe.ranks_are_ordered(ranks)
    path = tmp_path / "unordered.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in sorted(ranks.items(), key=lambda x: x[1])))
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randint(1, 60))), None, None) for i in range(200)] + [(200, "ccc ccc", None, None)]
    got = {x.doc_id: x.ids for x in bpe.encode(documents(spark, rows), str(path), public_tokenizers.PATTERN).collect()}
    enc = encoder(path)
    assert got == {i: enc.encode_ordinary(t) for i, t, *_ in rows}
    assert bpe.ranks_are_ordered({bytes([b]): b for b in range(256)} | {b"ab": 299, b"abc": 300})


def test_empty_table(spark):
    assert bpe.coding_report(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0
