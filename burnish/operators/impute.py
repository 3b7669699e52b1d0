"""Fill nulls in numeric columns from the other numeric columns: nearest neighbours, forests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.ordering import with_rank
from burnish.functions.scratch import stage
from burnish.functions.types import col, fresh_name, is_integral, is_numeric, numeric_columns, require_order
from burnish.operators.nulls import columns_with_nulls, fill_nulls, nulls_filled
from burnish.operators.outcome import Outcome

CHUNK_ROWS = 20_000
MOST_CELLS, CELL_ROWS = 1_000, 1_000
BLOCK = 256


def fill_nulls_ml(
    df: DataFrame, column: str | None = None, strategy: str = "knn", n_neighbors: int = 5, order_by=None, max_rounds: int = 20
) -> Outcome:
    """Fill nulls of one numeric column, or of all, from every numeric column of the table.

    ``knn`` averages the nearest rows, ``rf`` predicts with random forests. Whole-number columns
    stay whole. With fewer than two numeric columns: mean for numbers, mode for the rest.
    """
    if strategy not in ("knn", "rf"):
        raise ValueError(f"Unknown strategy: {strategy}")
    features = numeric_columns(df)
    if len(features) < 2:
        return fallback_fill(df, column)
    targets = [c for c in columns_with_nulls(df, column) if c in features]
    details = {"strategy": strategy, "column": column, "columns": targets}
    if not targets:
        return Outcome(df, "fill_nulls_ml", details=details, template="No nulls to fill.")
    if strategy == "knn":
        after = knn_impute(df, features, targets, n_neighbors, order_by)
    else:
        after = forest_impute(df, features, targets, order_by, max_rounds)
    return Outcome(
        after, "fill_nulls_ml", nulls_filled(df, after, targets), details, "{rows_affected:,} nulls filled ({strategy}) in {columns}."
    )


def fallback_fill(df: DataFrame, column: str | None = None) -> Outcome:
    """Mean for numeric columns, mode for the others."""
    names = columns_with_nulls(df, column)
    after = df
    for c in names:
        after = fill_nulls(after, c, "mean" if is_numeric(df.schema[c].dataType) else "mode").df
    metrics = nulls_filled(df, after, names) if names else None
    return Outcome(
        after, "fill_nulls_ml", metrics, {"strategy": "mean/mode", "column": column, "columns": names},
        "{rows_affected:,} nulls filled ({strategy}) in {columns}.",
    )


def fill_report(before: DataFrame, after: DataFrame, columns: list[str], method: str) -> DataFrame:
    """(column, filled, method) for the columns in which nulls were filled."""

    def melted(df: DataFrame, sign: int) -> DataFrame:
        counts = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
        entries = [F.struct(F.lit(c).alias("column"), (F.col(f"n{i}") * sign).alias("n")) for i, c in enumerate(columns)]
        return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

    total = melted(before, 1).unionAll(melted(after, -1)).groupBy("column").agg(F.sum("n").alias("filled"))
    return total.where("filled > 0").withColumn("method", F.lit(method))


def _usable(name: str) -> Column:
    """The cell as a double; null, NaN and infinities are all missing (NaN)."""
    value = col(name).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(float("nan")))


def _typed(value: Column, dtype: T.DataType) -> Column:
    return F.round(value, 0).cast(dtype) if is_integral(dtype) else value.cast(dtype)


# -- nearest neighbours ---------------------------------------------------------------------

class _Cells:
    """The table cut into cells along two numeric columns; a row that lacks one lies in a strip of its own there.

    Edges are approximate quantiles, so strips hold about equally many rows unless one value repeats.
    They only steer the search; the result does not depend on them. All look-ups are column
    expressions over the few edges.
    """

    def __init__(self, rows: DataFrame, axes: list[int], total: int):
        self.axes = axes
        strips = max(1, math.isqrt(min(MOST_CELLS, max(1, total // CELL_ROWS))))
        probs = [i / strips for i in range(1, strips)]
        points = rows.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), probs, 10_000) for v in map(self._value, axes)]).first() if probs else [[]] * len(axes)
        self.edges = [np.unique(np.array(p or [], dtype="float64")).tolist() for p in points]

    @staticmethod
    def _value(axis: int) -> Column:
        return F.element_at("x", axis + 1)

    @staticmethod
    def _numbers(values: list[float]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<double>")

    def _strip(self, at: int, value: Column) -> Column:
        return F.size(F.filter(self._numbers(self.edges[at]), lambda e: e <= value))

    def _cell(self, strips: list[Column]) -> Column:
        out = F.lit(0)
        for edges, strip in zip(self.edges, strips):
            out = out * (len(edges) + 2) + strip + 1
        return out.cast("int")

    def number(self, middle: bool = False) -> Column:
        """The cell of a row; ``middle`` puts rows that lack a column into the middle strip instead."""
        strips = []
        for at, axis in enumerate(self.axes):
            lacking = F.isnan(self._value(axis))
            strips.append(F.when(lacking, F.lit(len(self.edges[at]) // 2 if middle else -1)).otherwise(self._strip(at, self._value(axis))))
        return self._cell(strips)

    def within(self, share: float) -> Column:
        """Cells that can hold a row closer than ``radius``; ``share`` turns radius into length along the axes.

        A row without a column may be near on the others alone, so its strip is always among them.
        """
        seen = F.size(F.filter("x", lambda v: ~F.isnan(v)))
        # Widened a little, so rounding never loses a cell.
        span = F.coalesce(F.col("radius"), F.lit(float("inf"))) * F.sqrt(seen * F.lit(share)) * (1 + 1e-9) + 1e-12

        def strips(at: int) -> Column:
            value, last = self._value(self.axes[at]), len(self.edges[at])
            near = F.sequence(self._strip(at, value - span), self._strip(at, value + span))
            return F.concat(F.array(F.lit(-1)), F.when(F.isnan(value) | (span == float("inf")), F.sequence(F.lit(0), F.lit(last))).otherwise(near))

        def gap(at: int, strip: Column) -> Column:
            """How far the strip is from the row's value."""
            value, edges = self._value(self.axes[at]), self.edges[at]
            low, high = self._numbers([-math.inf, *edges]), self._numbers([*edges, math.inf])
            away = F.greatest(F.lit(0.0), F.get(low, strip) - value, value - F.get(high, strip))
            return F.when((strip < 0) | F.isnan(value), F.lit(0.0)).otherwise(away)

        if len(self.axes) == 1:
            return F.transform(strips(0), lambda i: self._cell([i]))
        box = lambda i, j: gap(0, i) * gap(0, i) + gap(1, j) * gap(1, j) <= span * span
        return F.flatten(F.transform(strips(0), lambda i: F.transform(F.filter(strips(1), lambda j: box(i, j)), lambda j: self._cell([i, j]))))


def _closest(seekers: pd.DataFrame, donors: pd.DataFrame, targets: list[int], k: int) -> pd.DataFrame:
    """The k nearest donors in this block for each missing target of each seeker.

    Distance over the columns both rows have, scaled up for those they lack:
    (all columns / shared columns) * sum of squares.
    """
    out = {"id": [], "target": [], "distance": [], "donor": [], "value": []}
    if len(seekers) and len(donors):
        donors = donors.sort_values("id")
        ids, ys = donors["id"].to_numpy(), np.stack(donors["x"].to_numpy()).astype("float64")
        has = ~np.isnan(ys)
        for start in range(0, len(seekers), BLOCK):
            part = seekers.iloc[start : start + BLOCK]
            own, xs = part["id"].to_numpy(), np.stack(part["x"].to_numpy()).astype("float64")
            total, shared = np.zeros((len(xs), len(ys))), np.zeros((len(xs), len(ys)))
            for j in range(ys.shape[1]):
                gap = (xs[:, j, None] - ys[None, :, j]) ** 2
                known = ~np.isnan(gap)
                total[known] += gap[known]
                shared += known
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.where(shared > 0, total * (ys.shape[1] / shared), np.inf)
            for t in targets:
                lack = np.flatnonzero(np.isnan(xs[:, t]))
                give = np.flatnonzero(has[:, t])
                if not len(lack) or not len(give):
                    continue
                d = distance[np.ix_(lack, give)]
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(d, order, axis=1)
                row, place = np.nonzero(np.isfinite(best))
                chosen = give[order[row, place]]
                out["id"].append(own[lack[row]])
                out["target"].append(np.full(len(row), t))
                out["distance"].append(best[row, place])
                out["donor"].append(ids[chosen])
                out["value"].append(ys[chosen, t])
    return pd.DataFrame({c: np.concatenate(v) if v else np.array([]) for c, v in out.items()})


def _parts(sizes: DataFrame) -> DataFrame:
    """Number of chunks each cell is cut into; at most one line per cell."""
    return sizes.select("slice", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("parts"))


def knn_impute(df: DataFrame, features: list[str], targets: list[str], n_neighbors: int = 5, order_by=None) -> DataFrame:
    """Each missing target becomes the mean of the k nearest rows that have it.

    Exact without comparing all rows. The table is cut into cells along two columns. Rows with gaps
    first meet one chunk of a cell, which bounds how far their k-th neighbour can be; then they meet
    the cells within that bound of them, chunk by chunk. A chunk pair hands on k rows for
    each gap, never its pairs. Ties go to the row that is first under ``order_by``.
    """
    order = require_order(order_by, "Nearest-neighbour filling")
    tag = fresh_name(df, "__id")
    numbered = with_rank(df, order, tag)
    x = F.array(*[_usable(c) for c in features]).alias("x")
    rows = numbered.select(F.col(tag).alias("id"), x)
    wanted = [features.index(c) for c in targets]

    cell = [F.element_at("x", i + 1) for i in range(len(features))]
    there = [~F.isnan(c) for c in cell]
    complete = there[0]
    for t in there[1:]:
        complete = complete & t
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(complete).alias("complete"),
        *[F.count_if(t).alias(f"n{i}") for i, t in enumerate(there)],
        *[F.avg(F.when(t, c)).alias(f"m{i}") for i, (t, c) in enumerate(zip(there, cell))],
        *[F.stddev_samp(F.when(t, c)).alias(f"s{i}") for i, (t, c) in enumerate(zip(there, cell))],
    ).first()
    k = min(n_neighbors, max(1, stats["complete"] - 1))
    # The search axes: fewest gaps first, then widest spread.
    axes = sorted(range(len(features)), key=lambda i: (-stats[f"n{i}"], -(stats[f"s{i}"] or 0.0)))[:2]
    cells = _Cells(rows, axes, stats["rows"])
    share = 1.0 / len(features)

    placed = stage(rows.withColumn("slice", cells.number()), "cells")
    parts = _parts(placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n")))
    donors = placed.join(F.broadcast(parts), "slice").select(
        "id", "x", "slice", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("chunk")
    )
    lacking = F.lit(False)
    for t in wanted:
        lacking = lacking | F.isnan(F.element_at("x", t + 1))
    seekers = placed.where(lacking)
    schema = "id long, target int, distance double, donor long, value double"

    def search(seeking: DataFrame, giving: DataFrame) -> DataFrame:
        """Both sides in chunks: every seeker chunk of a slice meets every donor chunk of it."""
        cuts = _parts(seeking.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("parts", "cuts")
        left = seeking.join(F.broadcast(cuts), "slice").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        right = giving.join(F.broadcast(cuts), "slice").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        keys = ["slice", "chunk", "cut"]
        # New names for one side: both stem from the same table.
        right = right.select(*[F.col(c).alias(c) for c in (*keys, "id", "x")])
        return (
            left.select(*keys, "id", "x")
            .groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInPandas(lambda a, b: _closest(a, b, wanted, k).astype({"id": "int64", "target": "int32", "donor": "int64"}), schema)
        )

    # A seeker that lacks an axis looks where most rows are first: in its own strip all lack it.
    near = search(seekers.withColumn("slice", cells.number(middle=True)).withColumn("chunk", F.lit(0)), donors.where(F.col("chunk") == 0))
    # Only a full set of k rows bounds the k-th distance; a seeker is bound by its worst gap.
    bounds = near.groupBy("id", "target").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    gaps = seekers.select(
        "id", "x", F.explode(F.filter(F.array(*[F.when(F.isnan(F.element_at("x", t + 1)), F.lit(t)) for t in wanted]), lambda v: v.isNotNull())).alias("target")
    )
    reach = (
        gaps.join(bounds, ["id", "target"], "left")
        .groupBy("id")
        .agg(F.first("x").alias("x"), F.sqrt(F.max(F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))))).alias("radius"))
    )
    wide = (
        reach.withColumn("slice", F.explode(cells.within(share)))
        .join(F.broadcast(parts), "slice")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "x", "slice", "chunk")
    )
    found = search(stage(wide, "reach"), donors)
    place = F.row_number().over(Window.partitionBy("id", "target").orderBy("distance", "donor"))
    means = (
        found.withColumn("place", place).where(F.col("place") <= k).groupBy("id", "target").agg(F.avg("value").alias("value"))
    )
    filled = means.groupBy(F.col("id").alias(tag)).agg(
        *[F.max(F.when(F.col("target") == t, F.col("value"))).alias(f"__k{t}") for t in wanted]
    )
    after = {}
    for c, t in zip(targets, wanted):
        if stats[f"m{t}"] is not None:
            value = F.coalesce(F.col(f"__k{t}"), F.lit(stats[f"m{t}"]))
            after[c] = F.when(F.isnan(_usable(c)), _typed(value, df.schema[c].dataType)).otherwise(col(c))
    return numbered.join(filled, tag, "left").withColumns(after).select(*[col(c) for c in df.columns])


# -- forests --------------------------------------------------------------------------------

def forest_impute(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    order_by=None,
    max_rounds: int = 20,
    trees: int = 50,
    tolerance: float = 1e-3,
    seed: int = 42,
) -> DataFrame:
    """Round-robin regression: each target is predicted from the other columns by a random forest.

    Missing cells start at the column mean; columns with fewest gaps go first; rounds end when no
    prediction moves by more than ``tolerance`` times the largest observed value.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    order = require_order(order_by, "Forest filling")
    tag = fresh_name(df, "__id")
    numbered = with_rank(df, order, tag)
    numbers = {c: f"f{i}" for i, c in enumerate(features)}
    work = numbered.select(
        F.col(tag).alias("id"),
        *[_usable(c).alias(n) for c, n in numbers.items()],
        *[F.isnan(_usable(c)).alias(f"{n}_gap") for c, n in numbers.items()],
    )
    stats = work.agg(
        *[F.count_if(f"{n}_gap").alias(f"{n}_gaps") for n in numbers.values()],
        *[F.avg(F.when(~F.col(f"{n}_gap"), F.col(n))).alias(f"{n}_mean") for n in numbers.values()],
        *[F.max(F.when(~F.col(f"{n}_gap"), F.abs(n))).alias(f"{n}_top") for n in numbers.values()],
    ).first()
    # A column without a single value can neither be filled nor help.
    numbers = {c: n for c, n in numbers.items() if stats[f"{n}_mean"] is not None}
    gappy = sorted((c for c in numbers if stats[f"{numbers[c]}_gaps"]), key=lambda c: stats[f"{numbers[c]}_gaps"])
    limit = tolerance * max(stats[f"{n}_top"] for n in numbers.values())
    work = stage(
        work.withColumns({n: F.when(F.col(f"{n}_gap"), F.lit(stats[f"{n}_mean"])).otherwise(F.col(n)) for n in numbers.values()}),
        "forest",
    )
    for _ in range(max_rounds):
        before = work
        for c in gappy:
            n = numbers[c]
            inputs = VectorAssembler(inputCols=[m for m in numbers.values() if m != n], outputCol="inputs")
            forest = RandomForestRegressor(
                featuresCol="inputs", labelCol=n, predictionCol="guess", numTrees=trees, seed=seed, maxDepth=10
            )
            model = forest.fit(inputs.transform(work.where(~F.col(f"{n}_gap"))))
            guessed = model.transform(inputs.transform(work))
            work = guessed.withColumn(n, F.when(F.col(f"{n}_gap"), F.col("guess")).otherwise(F.col(n))).drop("inputs", "guess")
        work = stage(work, "forest")
        if len(gappy) == 1:
            # Its inputs hold no predictions, so another round would predict the same.
            break
        moved = (
            before.select("id", *[F.col(numbers[c]).alias(f"{numbers[c]}_old") for c in gappy])
            .join(work, "id")
            .agg(F.max(F.greatest(*[F.abs(F.col(numbers[c]) - F.col(f"{numbers[c]}_old")) for c in gappy], F.lit(0.0))))
            .first()[0]
        )
        if moved is None or moved < limit:
            break
    guesses = work.select(F.col("id").alias(tag), *[F.col(numbers[c]).alias(f"__{numbers[c]}") for c in targets if c in numbers])
    after = {
        c: F.when(F.isnan(_usable(c)), _typed(F.col(f"__{numbers[c]}"), df.schema[c].dataType)).otherwise(col(c))
        for c in targets
        if c in numbers
    }
    return numbered.join(guesses, tag, "left").withColumns(after).select(*[col(c) for c in df.columns])
