"""Exact order statistics and most-frequent values of whole columns.

Both avoid the value-to-count map that an exact percentile or mode aggregate keeps in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.types import col, is_numeric

ACCURACY = 10_000
BRACKET_ROWS = 100_000


@dataclass(frozen=True)
class Rank:
    """Wanted positions among n sorted values, all close to the fraction ``at``."""

    at: float
    indexes: Callable[[int], list[int]]


def nearest_rank(q: float) -> Rank:
    """The value nearest to quantile q."""
    return Rank(q, lambda n: [math.floor((n - 1) * q + 0.5)])


MIDDLE = Rank(0.5, lambda n: [(n - 1) // 2, n // 2])


@dataclass
class _Bracket:
    """Value range known to hold the wanted rank, and how many rows lie below it."""

    column: str
    index: int
    low: float | int
    high: float | int
    below: int
    inside: int


def order_statistics(df: DataFrame, wanted: dict[str, list[Rank]]) -> dict[str, list[list]]:
    """Exact values at the given ranks of each column, nulls left out.

    One aggregate takes approximate percentiles around each rank; their proven rank error gives a
    value range that must hold the exact answer. Ranges are narrowed the same way until small,
    and only the values inside them are grouped, sorted and counted. Returns, per column and
    rank, the values (an empty list when the column has none).
    """
    columns = [c for c in wanted if wanted[c]]
    if not columns:
        return {}
    step = 2.0 / ACCURACY
    sizes = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(col(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
        *[
            F.percentile_approx(
                col(c), [min(1.0, max(0.0, r.at + d)) for r in wanted[c] for d in (-step, step)], ACCURACY
            ).alias(f"p{i}")
            for i, c in enumerate(columns)
        ],
    ).first()

    brackets: dict[tuple[str, int], _Bracket] = {}
    ranks: dict[str, list[list[int]]] = {}
    for i, c in enumerate(columns):
        n = sizes[f"n{i}"]
        ranks[c] = [r.indexes(n) if n else [] for r in wanted[c]]
        for j, r in enumerate(wanted[c]):
            low, high = sizes[f"lo{i}"], sizes[f"hi{i}"]
            if n > BRACKET_ROWS:
                # The whole range stays where the widened percentile would pass an end.
                low = sizes[f"p{i}"][2 * j] if r.at > step else low
                high = sizes[f"p{i}"][2 * j + 1] if r.at < 1 - step else high
            for index in ranks[c][j]:
                brackets[(c, index)] = _Bracket(c, index, low, high, 0, n)
    _narrow(df, brackets)
    found = _pick(df, list(brackets.values()))
    return {c: [[found[(c, r)] for r in rs] for rs in ranks[c]] for c in columns}


def _within(b: _Bracket) -> Column:
    return col(b.column).between(F.lit(b.low), F.lit(b.high))


def _narrow(df: DataFrame, brackets: dict) -> None:
    """Count each range exactly and shrink those that are still large."""
    step = 2.0 / ACCURACY
    pending = [k for k, b in brackets.items() if b.inside > BRACKET_ROWS]
    while pending:
        bs = [brackets[k] for k in pending]
        counted = df.agg(
            *[F.count_if(col(b.column) < F.lit(b.low)).alias(f"b{i}") for i, b in enumerate(bs)],
            *[F.count_if(_within(b)).alias(f"n{i}") for i, b in enumerate(bs)],
        ).first()
        large = []
        for i, b in enumerate(bs):
            b.below, b.inside = counted[f"b{i}"], counted[f"n{i}"]
            if b.inside > BRACKET_ROWS and b.low != b.high:
                large.append(b)
        if not large:
            break
        points = df.agg(
            *[
                F.percentile_approx(
                    F.when(_within(b), col(b.column)),
                    [
                        max(0.0, (b.index - b.below) / b.inside - step),
                        min(1.0, (b.index - b.below) / b.inside + step),
                    ],
                    ACCURACY,
                ).alias(f"p{i}")
                for i, b in enumerate(large)
            ]
        ).first()
        pending = []
        for i, b in enumerate(large):
            low, high = points[f"p{i}"]
            if (low, high) != (b.low, b.high):
                b.low, b.high = low, high
                pending.append((b.column, b.index))


def _exact_as_double(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType))


def _pick(df: DataFrame, brackets: list[_Bracket]) -> dict:
    """The value at each wanted rank, from the values inside its range."""
    found = {(b.column, b.index): b.low for b in brackets if b.low == b.high}
    brackets = [b for b in brackets if b.low != b.high]
    if not brackets:
        return found
    # One pass: every row gives its value once for each range that holds it. The text form tells
    # apart values that agree as doubles.
    text = [
        F.lit("") if _exact_as_double(df.schema[b.column].dataType) else col(b.column).cast("string") for b in brackets
    ]
    tagged = F.array(
        *[
            F.when(_within(b), F.struct(F.lit(i).alias("k"), col(b.column).cast("double").alias("x"), text[i].alias("s")))
            for i, b in enumerate(brackets)
        ]
    )
    counts = (
        df.select(F.explode(tagged).alias("t"))
        .where("t IS NOT NULL")
        .groupBy(F.col("t.k").alias("k"), F.col("t.x").alias("x"), F.col("t.s").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("x", "s").rowsBetween(Window.unboundedPreceding, 0))
    target = F.element_at(F.array(*[F.lit(b.index - b.below) for b in brackets]), F.col("k") + 1)
    rows = (
        counts.withColumn("upto", upto)
        .where((F.col("upto") > target) & (F.col("upto") - F.col("n") <= target))
        .select("k", "x", "s")
        .collect()
    )
    for row in rows:
        b = brackets[row.k]
        found[(b.column, b.index)] = type(b.low)(row.s or row.x)
    return found


def nearest_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list]:
    """Exact nearest-rank quantiles per column; columns without values are left out."""
    found = order_statistics(df, {c: [nearest_rank(q) for q in probs] for c in columns})
    return {c: [v[0] for v in vs] for c, vs in found.items() if all(vs)}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    found = order_statistics(df, {c: [MIDDLE] for c in columns})
    return {c: (float(vs[0][0]) + float(vs[0][1])) / 2 for c, vs in found.items() if vs[0]}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value of each column as a string; the smallest one when several tie."""
    if not columns:
        return {}
    numbered = F.array(
        *[
            F.when(
                col(c).isNotNull(),
                F.struct(
                    F.lit(i).alias("k"),
                    (col(c).cast("double") if is_numeric(df.schema[c].dataType) else F.lit(None).cast("double")).alias("x"),
                    col(c).cast("string").alias("s"),
                ),
            )
            for i, c in enumerate(columns)
        ]
    )
    counts = (
        df.select(F.explode(numbered).alias("t"))
        .where("t IS NOT NULL")
        .groupBy(F.col("t.k").alias("k"), F.col("t.x").alias("x"), F.col("t.s").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), "x", "s")).alias("top"))
    return {columns[row.k]: row.top.s for row in best.collect()}
