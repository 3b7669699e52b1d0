"""Alignment of two tokenizers against whole texts and cumulated byte lengths."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from burnish.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_report(rows: list[tuple]) -> list[tuple]:
    """Every text encoded whole; byte offsets are sums of decoded lengths."""
    pair, links, lines = align.Pair(A, B), Counter(), []
    for doc_id, text in rows:
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        a_bytes, b_bytes = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {b" " + text.encode()}:
            lines.append((doc_id, 0, 0, [], []))
            continue
        a_at, b_at = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        cuts = sorted(set(a_at) & set(b_at))
        pairs = [(a[a_at.index(c)], b[b_at.index(c)]) for c in cuts]
        groups = []
        for start, end in zip([0, *cuts], cuts):
            mine = [",".join(str(i) for i, at in zip(ids, ats) if start < at <= end) for ids, ats in ((a, a_at), (b, b_at))]
            groups.append("|".join(mine))
        links.update(pairs)
        lines.append((doc_id, len(a), len(b), groups, pairs))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [
        (
            doc_id, n_a, n_b, len(groups), len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, n_a, n_b, groups, pairs in lines
    ]


ODD = [
    None, "", " ", "  two  spaces ", "a\tb\nc d 　 e", "héllo wörld 日本語 🧿🧿 ͸ x", "▁ written sign", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "nul \x00 \x1c fs", "word" * 5000, "it's don't 've  'll", "ᠮᠣᠩ᠎ᠭᠣ ᠎ x", "﻿bom é ​", "same same same",
]


@pytest.mark.parametrize("sent", [align.SENT, 0])
def test_agrees_with_whole_texts(spark, sent):
    rng = random.Random(5)
    signs = "ab 1é  日🧿\n'\t.▁"
    texts = ODD + ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(150)] + ["same same same"] * 3
    rows = [(i % 160, t) for i, t in enumerate(texts)] + [(None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("codes", F.lit(1)).withColumn("row", F.lit("x")).repartition(4)
    got = sorted(map(tuple, align.alignment_report(df, A, B, sent=sent).collect()), key=str)
    assert got == sorted(plain_report(rows), key=str)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, align.alignment_report(df, A, B).collect())) == sorted(plain_report(rows))


def test_empty_table(spark):
    assert align.alignment_report(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_short_texts_are_read_side_by_side(monkeypatch):
    """Both tokenizers are slower on long texts; what is read together must not change what comes out."""
    pair, read = align.Pair(A, B), []
    side_by_side = pair._side_by_side
    chunks = [f"wörd{i}🧿" * (1 + i % 3) for i in range(3000)] + ["", " x", "▁", "x\ty"]
    monkeypatch.setattr(pair, "_side_by_side", lambda part: read.append(len(" ".join(part))) or side_by_side(part))
    got = pair.align(chunks)
    assert max(read) <= 4096 and len(read) < 100
    monkeypatch.setattr(align, "READ", 0)
    assert pair.align(chunks) == got


def test_refined_cuts():
    def cuts(coarse, tokens, text):
        got = align.refined(np.array(coarse), tokens, np.arange(len(tokens)), text.encode())
        return got if got is None else got.tolist()

    assert cuts([2, 3, 7, 7, 8], [" é".encode()[:2], b"\xa9", "🧿".encode()[:1], "🧿".encode()[1:], b"a"], " é🧿a") == [2, 3, 4, 7, 8]
    assert cuts([3, 3, 8], [" é".encode()[:1], " é".encode()[1:], "🧿a".encode()], " é🧿a") == [1, 3, 8]
    assert cuts([3, 8], [" é".encode(), "🧿b".encode()], " é🧿a") is None
    assert cuts([3], [" é".encode()], " é🧿a") is None


def test_known_chunks_do_not_hide_odd_spaces(spark, monkeypatch):
    """A chunk with white space at an end is never remembered; vocabularies are read once by a process."""
    monkeypatch.setattr(align, "SLICE", 1)
    texts = ["\nfoo bar", "a \nfoo", "x  y", " x y", "bar a", "x ", "y x  y", "foo\x85 bar", "foo\x85 bar a", "᠎a bar", "bar ᠎a"]
    pair, known = align.Pair(A, B), {}
    for text in texts * 2:
        (got,), edged = pair.chunks([text], known)
        assert got == align._BORDER.split(text)
        known.update((c, None) for c in got if c not in edged)
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    got = sorted(map(tuple, align.alignment_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B).collect()))
    assert got == sorted(plain_report(rows))
    assert align._pair(A, B, 0) is align._pair(A, B, 0) and align._pair(A, B, 1) is not align._pair(A, B, 0)
