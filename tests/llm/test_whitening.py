"""Whitening against a dense eigendecomposition and whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import whitening


def plain_whitening(vectors: list[list[float]], components: int):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(axis=0)
    off = (fit * n - sums).astype(float) / n
    values, columns = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:components]
    values, columns = values[order], columns[:, order]
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    return n, deviation.tolist(), ((x * n - sums).astype(float) / n) @ columns / np.sqrt(values), values / np.trace(off.T @ off / n)


def compare(got: list, vectors: dict[int, list[float]], components: int):
    ids = sorted(vectors)
    n, deviation, white, explained = plain_whitening([vectors[i] for i in ids], components)
    table = {(r["vec_id"], r["component"]): r for r in got}
    assert len(table) == len(got) == len(ids) * components
    for c in range(components):
        mine = np.array([table[i, c + 1]["whitened"] for i in ids])
        sign = 1 if abs(mine - white[:, c]).max() < abs(mine + white[:, c]).max() else -1
        assert mine == pytest.approx(sign * white[:, c], abs=1e-8)
        assert [table[i, c + 1]["deviation"] for i in ids] == deviation
        assert {table[i, c + 1]["n"] for i in ids} == {n}
        assert table[ids[0], c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    compare(whitening.whiten(df).collect(), rows, 16)


def test_copies_drops_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    good = {i: (rng.standard_normal(5) * [9, 5, 3, 2, 1] + 7).tolist() for i in range(40)}
    good |= {100 + i: good[0] for i in range(60)}
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1e300] * 5), (906, [1.0, 2.0])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>").withColumn("x", F.lit("a")).withColumn("n", F.lit(None))
    compare(whitening.whiten(df, components=5).collect(), good, 5)


def test_tables_without_components(spark):
    ddl = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], ddl)).count() == 0
    flat = spark.createDataFrame([(i if i else None, [float(i), 1.0]) for i in range(5)], ddl)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in whitening.whiten(flat).collect()) == [(i, 1) for i in range(5)]


@pytest.mark.parametrize("d, kinds", [(64, "noise"), (64, "equal"), (150, "falling"), (3, "noise")])
def test_solver_reaches_double_precision(d, kinds):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"noise": 1 + rng.random(d), "equal": np.repeat([4.0, 1.0], [d // 2, d - d // 2]), "falling": 0.8 ** np.arange(d)}[kinds]
    a = (q * values) @ q.T
    got, vectors = whitening.jacobi_davidson(lambda c: a @ c, d, 16)
    k = min(16, d)
    assert got == pytest.approx(np.sort(values)[::-1][:k], rel=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-13 * values.max()
    assert vectors.T @ vectors == pytest.approx(np.eye(k), abs=1e-13)


def test_deviations_beyond_a_long():
    x, rest = np.array([[3, -2], [1 << 40, 0]]), np.array([1, 0])
    assert whitening.deviations(x[:1], 10, rest) == [29 * 29 + 400]
    assert whitening.deviations(x, 1 << 20, rest)[1] is None
