import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gavelspark.llm import align, queries

from ..support import MIDDLE, SMALL
from .fixtures import EDGE, documents, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + sizes[i]))
        at += sizes[i]
    return out


def brute(rows):
    """Offsets as plain sets, links by comparing ranges, counts by a dictionary."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = align.byte_of_char()
    a_bytes = {i: bytes(chars[c] for c in t) for t, i in first.get_vocab().items() if all(c in chars for c in t)}
    b_bytes = {i: bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in range(second.get_piece_size()) for p in [second.id_to_piece(i)]}
    found = []
    for doc_id, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes.get(i, b"") for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a, b = [], []
        x, y = (spans(ids, {i: len(v) for i, v in t.items()}) for ids, t in ((a, a_bytes), (b, b_bytes)))
        links, k = [], 0
        for i, (p, q) in enumerate(x):
            while k and y[k - 1][1] > p:
                k -= 1
            while k < len(y) and y[k][0] < q:
                if y[k][1] > p:
                    links.append((i, k))
                k += 1
        cuts = sorted({q for _, q in x} & {q for _, q in y})
        groups, last = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s in zip(a, x) if last < s[1] <= cut) + "|" + ",".join(str(i) for i, s in zip(b, y) if last < s[1] <= cut) if len(raw) < 3000 else None)
            last = cut
        found.append((doc_id, a, b, links, groups))
    counts = Counter((a[i], b[k]) for _, a, b, links, _ in found for i, k in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, links, groups in found:
        held = [(counts[a[i], b[k]], most[b[k]]) for i, k in links]
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(n == m for n, m in held), sum(n for n, _ in held), digest))
    return out


def compared(got, want):
    key = lambda r: repr(r[:-1])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert all(w[-1] in (None, g[-1]) for g, w in zip(got, want))


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    compared(queries.QUERIES["op13_tokenizer_alignment"](spark, sf_dir).collect(), brute([(d.doc_id, d.text) for d in docs]))


ODD = [(600, "a▁b", None, None), (601, "<|endoftext|> <s> </s> <unk> <0x41>", None, None), (602, "  two  spaces \t\n", None, None), (603, "a" * 3000, None, None), (604, "éé\x00\x01🎉👩‍👧 ﬁ Ⅳ ½", None, None), (605, "﻿mark", None, None), (606, " ", None, None)]


@pytest.mark.parametrize("hot", [1, 50, 10**9])
def test_edge_and_odd_texts(spark, hot):
    """Pairs are counted alike whether all, some or none of them are broadcast."""
    rows = EDGE + ODD
    got = align.alignment_report(documents(spark, rows, clashes=True), A, B, hot=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    compared(got.collect(), brute([(x[0], x[1]) for x in rows]))


def test_aligned_tokens(spark):
    rows = EDGE[:4] + ODD[:3]
    got = {r.doc_id: r for r in align.align(documents(spark, rows), A, B).collect()}
    for (doc_id, n_a, n_b, n_groups, n_links, *_), row in zip(brute([(x[0], x[1]) for x in rows]), rows):
        r = got[doc_id]
        assert (len(r.a_ids), len(r.b_ids), len(r.a_cuts), len(r.a_links)) == (n_a, n_b, n_groups, n_links)
        assert not n_a or (r.a_cuts[-1], r.b_cuts[-1]) == (n_a, n_b)
        assert r.a_links == sorted(r.a_links) and set(r.a_links) == set(range(n_a)) and set(r.b_links) == set(range(n_b))


def test_long_text_is_cut_nowhere():
    c = align.aligner(A, B)
    text = "many words and numbers 12345 go on " * 40_000
    x = c.align([text, None, "x"])
    assert x.a_doc[1] == x.a_doc[2] == len(c.tokens([text])[0][0]) and x.group_doc[3] == x.group_doc[2] + 1


def test_pieces_give_the_ids_of_whole_texts():
    """Cut texts against whole ones, with white space of many kinds next to spaces."""
    c = align.aligner(A, B)
    assert c.local
    r = random.Random(7)
    pool = "    ab1.,'s\n\t\r\x0b\x0c\x1c\x1f\x85\u00a0\u1680\u180e\u2003\u200b\u2028\u3000\ufeff\x00é\u0301ßж東🎉½Ⅳ▁<>_-"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(4000)] + [" ", "  ", "a ", "a  ", " a", "a \n b", "a\n \nb", "x" * 500 + " y " * 40, "it's  they'll 's"]
    (a, a_ends), (b, b_ends) = c.tokens(texts)
    first = [e.ids for e in c.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    kept = 0
    for k, t in enumerate(texts):
        x, y, raw = first[k], c.second.encode(t), (" " + t).encode()
        if b"".join(c.a_bytes[i] for i in x) != raw or b"".join(c.b_bytes[i] for i in y) != raw:
            x, y = [], []
        kept += bool(x)
        assert (a[a_ends[k] : a_ends[k + 1]].tolist(), b[b_ends[k] : b_ends[k + 1]].tolist()) == (x, y), repr(t)
    assert kept > 1000


def test_empty_table(spark):
    assert align.alignment_report(empty(spark), A, B).collect() == []
    assert align.align(empty(spark), A, B).collect() == []
