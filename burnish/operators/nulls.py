"""Fill nulls from the column itself: mean, median, mode, last value, zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.ordering import in_ranges
from burnish.functions.statistics import medians, modes
from burnish.functions.types import as_columns, col, fresh_name, is_numeric, is_text, require_order
from burnish.operators.outcome import Outcome

STRATEGIES = ("mean", "median", "mode", "forward", "zero")


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def columns_with_nulls(df: DataFrame, column: str | None) -> list[str]:
    """The given column, or all, as far as they hold nulls."""
    names = [column] if column else df.columns
    counted = null_counts(df, [c for c in names if c in df.columns])
    return [c for c, n in counted.items() if n]


def nulls_filled(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """rows_affected = nulls before - nulls after in the given columns."""

    def total(df: DataFrame) -> Column:
        return sum((F.count_if(col(c).isNull()) for c in columns), F.lit(0)).alias("n")

    left = before.agg(total(before))
    right = after.agg((-total(after)).alias("n"))
    return left.unionAll(right).agg(F.sum("n").alias("rows_affected"))


def forward_fill(df: DataFrame, columns: list[str], order_by, partition_by: list[str] = ()) -> DataFrame:
    """Replace each null by the last non-null value above it, within ``partition_by`` if given.

    A window over the whole table, or over one hot key, would be one task. Here rows are cut into
    ranges of (key, order); a value crosses from range to range by way of a table with one line
    per range, joined on the key it belongs to.
    """
    order = require_order(order_by, "Forward fill")
    keys = as_columns(list(partition_by))
    tag = fresh_name(df, "__range")
    key = F.struct(*keys) if keys else F.lit(0)
    ranged = in_ranges(df, [*keys, *order], tag).withColumn("__key", key)
    latest = [F.max_by(col(c), F.when(col(c).isNotNull(), F.struct(*order))).alias(f"__v{i}") for i, c in enumerate(columns)]
    ends = ranged.groupBy(tag).agg(F.min("__key").alias("__first"), F.max("__key").alias("__last"))
    tails = (
        ranged.join(ends.select(tag, F.col("__last").alias("__key")), [tag, "__key"]).groupBy(tag, "__key").agg(*latest)
    )
    # One line per range for its first key, and one for its last; what came last above a first key is carried.
    blank = [F.lit(None).cast(tails.schema[f"__v{i}"].dataType).alias(f"__v{i}") for i in range(len(columns))]
    heads = ends.select(tag, F.col("__first").alias("__key"), F.lit(0).alias("__side"), *blank)
    lines = heads.unionByName(tails.withColumn("__side", F.lit(1)))
    so_far = Window.partitionBy("__key").orderBy(tag, "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        lines.withColumns({f"__c{i}": F.last(f"__v{i}", ignorenulls=True).over(so_far) for i in range(len(columns))})
        .where("__side = 0")
        .select(tag, "__key", *[f"__c{i}" for i in range(len(columns))])
    )
    above = Window.partitionBy(tag, "__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(col(c), ignorenulls=True).over(above), F.col(f"__c{i}")) for i, c in enumerate(columns)
    }
    return (
        ranged.join(carried, [tag, "__key"], "left").withColumns(filled).select(*[col(c) for c in df.columns])
    )


def fill_nulls(
    df: DataFrame,
    column: str | None = None,
    strategy: str = "mode",
    order_by=None,
    partition_by: list[str] = (),
) -> Outcome:
    """Fill the nulls of one column, or of every column that has some.

    ``mean`` and ``median`` apply to numbers and give doubles; ``zero`` is 0 for numbers and ''
    for text. Columns a strategy does not fit are left alone.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    names = columns_with_nulls(df, column)
    types = {c: df.schema[c].dataType for c in names}
    numbers = [c for c in names if is_numeric(types[c])]
    if strategy == "zero":
        odd = [c for c in names if not is_numeric(types[c]) and not is_text(types[c])]
        if column and odd:
            raise ValueError(f"Column '{column}' ({types[column].simpleString()}) has no zero.")
    fill: dict[str, Column] = {}
    if strategy == "mean" and numbers:
        means = df.agg(*[F.avg(col(c)).cast("double").alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        fill = {c: F.lit(means[f"m{i}"]) for i, c in enumerate(numbers) if means[f"m{i}"] is not None}
    elif strategy == "median":
        fill = {c: F.lit(v) for c, v in medians(df, numbers).items()}
    elif strategy == "mode":
        plain = [c for c in names if isinstance(types[c], T.AtomicType)]
        fill = {c: F.lit(v).cast(types[c]) for c, v in modes(df, plain).items()}
    elif strategy == "zero":
        fill = {c: (F.lit(0).cast(types[c]) if is_numeric(types[c]) else F.lit("")) for c in names if c in numbers or is_text(types[c])}
    if strategy == "forward":
        touched = names
        after = forward_fill(df, names, order_by, partition_by) if names else df
    else:
        touched = list(fill)
        after = df.withColumns({c: F.coalesce(col(c), v) for c, v in fill.items()}) if fill else df
    return Outcome(
        after,
        "fill_nulls",
        nulls_filled(df, after, touched) if touched else None,
        {"strategy": strategy, "column": column, "columns": touched},
        "{rows_affected:,} nulls filled ({strategy}) in {columns}.",
    )
