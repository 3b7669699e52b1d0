"""Formats, nulls, imputation, outliers and order statistics on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.functions import statistics as stats
from burnish.operators import columns as cols
from burnish.operators import impute, nulls, outliers
from burnish.operators import relational as rel
from burnish.plans import actions as act


def values(df, order, column):
    return [r[column] for r in df.orderBy(order).collect()]


def numbers(spark, xs, dtype="double"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"id long, x {dtype}")


def test_casing(spark):
    df = spark.createDataFrame([(1, "o'neil McDonald"), (2, None), (3, "ÉCOLE 3rd-b")], "id long, s string")
    assert values(cols.change_case(df, "s", "titlecase").df, "id", "s") == ["O'Neil Mcdonald", None, "École 3rd-B"]
    once = cols.change_case(df, "s", "lowercase").df
    assert once.collect() == cols.change_case(once, "s", "lowercase").df.collect()
    for bad in (("nope", "lowercase"), ("id", "lowercase"), ("s", "camel")):
        with pytest.raises(ValueError):
            cols.change_case(df, *bad)


def test_fix_formats(spark):
    df = spark.createDataFrame(
        [(1, " A@X.Org\t", "a "), (2, None, " b b "), (3, "b@y.org", None)], "id long, mail string, note string"
    )
    out = cols.fix_formats(df)
    assert values(out.df, "id", "mail") == ["a@x.org", None, "b@y.org"]
    assert values(out.df, "id", "note") == ["a", "b b", None]
    assert out.rows_affected == 3
    assert cols.fix_formats(out.df).rows_affected == 0
    days = spark.createDataFrame([("2024/03/01",), ("31/12/2023",), ("soon",)], "d string")
    assert [r.d for r in cols.fix_formats(days, "d", "dates").df.collect()] == ["2024-03-01", "2023-12-31", "soon"]


def test_one_late_email_is_enough(spark):
    df = spark.createDataFrame([(i, "X@Y" if i == 20 else " Z ") for i in range(30)], "id long, s string")
    assert cols.email_columns(df, ["s"]) == ["s"]
    assert cols.email_columns(df.where("not contains(s, '@')"), ["s"]) == []


def test_pinned_fills(spark):
    assert values(nulls.fill_nulls(numbers(spark, [1, None, 3], "bigint"), strategy="zero").df, "id", "x") == [1, 0, 3]
    filled = nulls.fill_nulls(numbers(spark, [1.0, None, None, 4.0]), strategy="forward", order_by="id")
    assert values(filled.df, "id", "x") == [1.0, 1.0, 1.0, 4.0]
    assert filled.rows_affected == 2
    lead = nulls.fill_nulls(numbers(spark, [None, 2.0, None]), strategy="forward", order_by="id")
    assert values(lead.df, "id", "x") == [None, 2.0, 2.0]
    mean = nulls.fill_nulls(numbers(spark, [1, None, 4], "int"), strategy="mean")
    assert values(mean.df, "id", "x") == [1.0, 2.5, 4.0]
    mode = nulls.fill_nulls(numbers(spark, ["b", "a", None, "a", "b"], "string"))
    assert values(mode.df, "id", "x") == ["b", "a", "a", "a", "b"]
    ties = nulls.fill_nulls(numbers(spark, [10, 9, None, 9, 10], "int"))
    assert values(ties.df, "id", "x")[2] == 9


def test_fill_leaves_the_rest_alone(spark):
    df = spark.createDataFrame([(1, None, True), (2, "x", None)], "id long, s string, b boolean")
    assert nulls.fill_nulls(df, strategy="mean").df.collect() == df.collect()
    zero = nulls.fill_nulls(df, strategy="zero").df
    assert values(zero, "id", "s") == ["", "x"] and values(zero, "id", "b") == [True, None]
    with pytest.raises(ValueError):
        nulls.fill_nulls(df, "b", "zero")
    with pytest.raises(ValueError):
        nulls.fill_nulls(df, strategy="forward")
    empty = nulls.fill_nulls(df.limit(0))
    assert empty.df.count() == 0 and empty.rows_affected == 0


def test_forward_fill_across_ranges_and_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2])), float(i) if rng.random() < 0.02 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k int, x double").repartition(8)
    for keys in ([], ["k"]):
        last, wanted = {}, {}
        for i, k, x in rows:
            k = k if keys else 0
            last[k] = x if x is not None else last.get(k)
            wanted[i] = last[k]
        out = nulls.fill_nulls(df, "x", "forward", order_by="id", partition_by=keys).df
        assert {r.id: r.x for r in out.collect()} == wanted


@pytest.mark.parametrize("bracket", [100_000, 5])
def test_order_statistics(spark, monkeypatch, bracket):
    monkeypatch.setattr(stats, "BRACKET_ROWS", bracket)
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8, 1001):
        xs = sorted(float(v) for v in rng.integers(0, 40, size=n))
        df = numbers(spark, [*xs, None])
        got = stats.nearest_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
        assert got == [xs[int((n - 1) * q + 0.5)] for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
        assert stats.medians(df, ["x"])["x"] == np.median(xs)
    assert stats.nearest_quantiles(numbers(spark, [None, None]), ["x"], [0.5]) == {}


def test_order_statistics_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET_ROWS", 50)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    xs = sorted([7] * 3000 + list(range(6000)))
    df = numbers(spark, xs, "bigint")
    got = stats.nearest_quantiles(df, ["x"], [0.1, 0.3, 0.5, 0.9])["x"]
    assert got == [xs[int((len(xs) - 1) * q + 0.5)] for q in (0.1, 0.3, 0.5, 0.9)]


def test_outliers(spark):
    df = numbers(spark, [*range(95), 500, 600, 700, 800, 900, None], "bigint")
    out = outliers.remove_outliers(df, "x")
    assert out.rows_affected == 5 and out.df.where("x IS NULL").count() == 1
    assert outliers.remove_outliers(df, "x", "zscore", 3.0).df.where("x >= 700").count() == 0
    assert outliers.remove_outliers(numbers(spark, [2.0, 2.0]), "x", "zscore").rows_affected == 0
    for bad in (("y",), ("x", "mad")):
        with pytest.raises(ValueError):
            outliers.remove_outliers(df, *bad)


def nearest_mean(rows, i, t, k):
    """Mean of the k nearest donors by direct comparison with every row."""
    found = []
    for j, y in enumerate(rows):
        if y[t] is None:
            continue
        both = [(a, b) for a, b in zip(rows[i], y) if a is not None and b is not None]
        if both:
            found.append((sum((a - b) ** 2 for a, b in both) * len(y) / len(both), j, y[t]))
    best = sorted(found)[:k]
    return sum(v for _, _, v in best) / len(best) if best else None


@pytest.mark.parametrize("chunk, cell_rows", [(20_000, 1_000), (30, 40)])
def test_nearest_rows_equal_full_comparison(spark, monkeypatch, chunk, cell_rows):
    monkeypatch.setattr(impute, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(impute, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(4)
    n = 2500 if cell_rows == 40 else 300
    rows = []
    for i in range(n):
        row = [float(rng.integers(0, 1000)), float(rng.normal(0, 3)), float(rng.integers(0, 5)), 1.0 if i % 3 else float(rng.normal())]
        rows.append([None if rng.random() < 0.03 and c else v for c, v in enumerate(row)])
        if rng.random() < 0.01:
            rows[-1][0] = None
    df = spark.createDataFrame([(f"r{i:05d}", *r) for i, r in enumerate(rows)], "id string, a double, b double, c double, d double")
    out = impute.fill_nulls_ml(df, n_neighbors=4, order_by="id")
    got = {r.id: r for r in out.df.collect()}
    for i, row in enumerate(rows):
        for t, c in enumerate("abcd"):
            want = nearest_mean(rows, i, t, 4) if row[t] is None else row[t]
            assert got[f"r{i:05d}"][c] == pytest.approx(want), (i, c)
    assert out.rows_affected == sum(v is None for r in rows for v in r)


def test_rows_without_an_axis_visit_few_cells(spark, monkeypatch):
    monkeypatch.setattr(impute, "CELL_ROWS", 20)
    rows = spark.range(4000).selectExpr("id", "array(if(id % 50 = 0, double('nan'), double(id % 613)), double(id % 409), 0.0D) as x")
    cells = impute._Cells(rows, [0, 1], 4000)
    seen = rows.withColumn("radius", F.lit(5.0)).withColumn("n", F.size(cells.within(1 / 3))).groupBy(F.isnan(F.element_at("x", 1)).alias("lacks")).agg(F.max("n").alias("n"))
    most = {r.lacks: r.n for r in seen.collect()}
    every = (len(cells.edges[0]) + 2) * (len(cells.edges[1]) + 2)
    assert most[False] < every / 8 and most[True] < every / 3


def test_imputation_keeps_types_and_falls_back(spark):
    df = spark.createDataFrame(
        [(25, 50000.0, 1.0, "a"), (None, 60000.0, None, "b"), (35, None, 3.0, "c"), (40, 80000.0, 4.0, None), (None, 90000.0, 5.0, "e"),
         (50, None, None, "f"), (55, 110000.0, 7.0, "g")],
        "age long, salary double, score double, name string",
    ).withColumn("id", F.monotonically_increasing_id())
    out = impute.fill_nulls_ml(df, "age", order_by="id").df
    assert out.schema == df.schema or [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert out.where("age IS NULL").count() == 0 and out.where("salary IS NULL").count() == 2
    assert sorted(map(str, out.select("name").collect())) == sorted(map(str, df.select("name").collect()))
    full = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert impute.fill_nulls_ml(full, order_by="a").rows_affected == 0
    text = spark.createDataFrame([("x",), (None,), ("x",)], "name string")
    assert [r.name for r in impute.fill_nulls_ml(text).df.collect()] == ["x", "x", "x"]


def test_forest_fills_and_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), None if i % 10 == 0 else float(3 * x)) for i, x in enumerate(rng.integers(0, 100, 200))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out = impute.forest_impute(df, ["x", "y"], ["y"], "id", max_rounds=2)
    got = {r.id: r.y for r in out.collect()}
    assert all(abs(got[i] - 3 * x) < 40 for i, x, y in rows if y is None)
    assert all(got[i] == y for i, x, y in rows if y is not None)


def test_no_size_decides(spark):
    few = spark.createDataFrame([(i, "North" if i % 2 else "NORTH") for i in range(10)], "id long, region string")
    cleaned, steps = act.auto_clean(few)
    assert any(s.type == "standardize" for s in steps) and {r.region for r in cleaned.collect()} <= {"North", "NORTH"}
    assert cleaned.select("region").distinct().count() == 1
    assert not any(s.type == "standardize" for s in act.auto_clean(few, leave_out=["region"])[1])


def test_chained_joins_keep_names_apart(spark, tmp_path):
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    out = t
    for _ in range(3):
        out = rel.join_tables(out, t, "k")
    out.write.parquet(str(tmp_path / "joined"))
    assert out.columns == ["k", "v", "k_right", "v_right", "k_right2", "v_right2", "k_right3", "v_right3"]


def test_number_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "n"))
    df = cols.grid_view(spark.read.parquet(str(tmp_path / "n")), [("id", "gt", "95")], ("id", "desc"))
    assert "GreaterThan(id,95" in df._jdf.queryExecution().toString() and [r.id for r in df.collect()] == [99, 98, 97, 96]


def test_aliases_stay_apart(spark):
    from burnish.sources.datasets import Datasets

    sets = Datasets(spark)
    one, two = sets.register("a b.csv", spark.range(1)), sets.register("a-b.csv", spark.range(2))
    assert one != two and sets["a_b"].count() == 1 and spark.table("a_b").count() == 1
    sets.remove(two)
    assert spark.table("a_b").count() == 1


def test_column_is_the_measure_next_to_a_key(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "g string, n long")
    out = act.apply_actions(df, [{"type": "aggregate", "params": {"by": "g", "function": "sum", "column": "n"}}])
    assert out.first().sum_n == 3
    with pytest.raises(ValueError):
        act.apply_actions(df, [{"type": "table"}])
