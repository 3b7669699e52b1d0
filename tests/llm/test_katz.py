"""The language model against plain dictionaries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from burnish.llm import katz
from burnish.llm.packing import pack, unpack

import numpy as np


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def plain_model(texts: list[str], order: int):
    """Katz backoff by dictionaries: counts by n-gram, histories listed whole, weights summed over the vocabulary."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        seq = [""] * (order - 1) + words(t) + ["\n"]
        for i in range(order - 1, len(seq)):
            for n in range(1, order + 1):
                counts[n][tuple(seq[i - n + 1 : i + 1])] += 1
    discounts = []
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        discounts.append(katz.Discounts.of([of[r] for r in range(1, katz.FEW + 2)]))
    total, after = [Counter() for _ in range(order + 1)], {}
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            after.setdefault(g[:-1], []).append(g[-1])

    def kept(n, c):
        d = discounts[n - 1].kept
        return d[c - 1] if c <= len(d) else c

    def probability(history, word):
        n = len(history) + 1
        if n > 1 and not total[n][history]:
            return probability(history[1:], word)
        lost = sum(counts[n][(*history, w)] - kept(n, counts[n][(*history, w)]) for w in after.get(history, ()))
        over = total[n][history] + (lost <= 0)
        lost = 1 if lost <= 0 else lost
        if c := counts[n][(*history, word)]:
            return kept(n, c) / over
        if n == 1:
            return lost / over
        rest = 1 - sum(probability(history[1:], w) for w in after[history])
        return lost / over / rest * probability(history[1:], word)

    return probability, counts


def plain_scores(texts, learnt, order):
    probability, counts = plain_model([t for t, use in zip(texts, learnt) if use], order)
    n_all, v = sum(counts[1].values()), len(counts[1])
    for t in texts:
        seq = [""] * (order - 1) + words(t) + ["\n"]
        places = range(order - 1, len(seq))
        known = sum(counts[1][(seq[i],)] > 0 for i in places)
        base = sum(math.log10((counts[1][(seq[i],)] + 0.5) / (n_all + 0.5 * (v + 1))) for i in places)
        yield len(places), known, n_all, base, sum(math.log10(probability(tuple(seq[i - order + 1 : i]), seq[i])) for i in places)


def made_texts(n: int) -> list[str]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["ÄB", "Zulu", "　x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return ["", "  \t"] + [" ".join(rng.choices(words, weights, k=rng.randint(1, 30))) for _ in range(n)] + ["hot pair " * 40] * 5


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("sizes", [{}, {"block": 37, "part": 100, "hot": 20}])
def test_agrees_with_dictionaries(spark, order, sizes):
    texts = made_texts(80)
    learnt = [i % 5 != 1 for i in range(len(texts))]
    rows = [(i, t, use, "x") for i, (t, use) in enumerate(zip(texts, learnt))]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score string").repartition(3)
    got, _ = katz.katz_scores(df, F.col("learn"), order, **sizes)
    want = list(plain_scores(texts, learnt, order))
    got = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    for i, w in enumerate(want):
        assert got[i][:3] == w[:3]
        assert got[i][3:] == pytest.approx(w[3:], rel=1e-9)


def test_probabilities_sum_to_one():
    probability, counts = plain_model(made_texts(60), 3)
    vocabulary = [g[0] for g in counts[1]] + ["never met"]
    for history in [("", ""), ("", "w0"), ("w0", "w1"), ("hot", "pair"), ("pair", "hot"), ("w2", "nowhere")]:
        assert sum(probability(history, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_the_tables_hold_every_trained_gram(spark):
    texts = made_texts(30)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    _, model = katz.katz_scores(df, F.lit(True), 2, block=50, part=60)
    _, counts = plain_model(texts, 2)
    stored = spark.read.parquet(f"{model.path}/order=2").where("kind = 'grams'").collect()
    assert sorted(c for r in stored for c in unpack(r["amounts"][0]).tolist()) == sorted(counts[2].values())
    assert model.words == len(counts[1]) and model.tokens == sum(counts[1].values())


def test_awkward_rows(spark):
    rows = [(None, None, None), (1, "a b", True), (1, "a b", True), (2, "a " * 3000, False), (3, "", True), (None, "b c", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens boolean").withColumn("row", F.lit(1)).withColumn("block", F.lit("x"))
    got, _ = katz.katz_scores(df, F.col("n_tokens"), 3, block=100)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == [(0, 1), (0, 3), (1, 3), (1, 3), (2, 3001), (3, 1)]
    untrained, _ = katz.katz_scores(df, F.lit(False))
    assert {(r["n_known"], r["score"]) for r in untrained.collect()} == {(0, 0.0)}
    empty, _ = katz.katz_scores(df.where("false"), F.lit(True))
    assert empty.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and empty.count() == 0


def test_packing():
    for values in (np.array([], np.uint32), np.array([1, 5, 1 << 31], np.uint32), np.array([0.5, -1e300])):
        assert (unpack(pack(values)) == values).all() and unpack(pack(values)).dtype == values.dtype
