"""Sort, slice, join, aggregate and union."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.ordering import with_row_index
from burnish.functions.types import col, fresh_name, quoted, require_column, require_order

SHALLOW_SLICE = 10_000
#: Rows that selection leaves to be sorted, keys of a sample, and types whose values it can name.
SELECTED_ROWS, SELECTED_SAMPLE = 100_000, 10_000
SELECTED_TYPES = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType
)


def sort_by(df: DataFrame, column: str, order: str = "desc", limit: int | None = None) -> DataFrame:
    """Sort by one column, nulls last in both directions; with ``limit`` this is a top-k."""
    require_column(df, column)
    if order.lower() not in ("asc", "desc"):
        raise ValueError(f"Unknown order: {order}")
    key = col(column).asc_nulls_last() if order.lower() == "asc" else col(column).desc_nulls_last()
    out = df.orderBy(key)
    return out.limit(limit) if limit is not None else out


def slice_rows(df: DataFrame, start: int = 0, stop: int = 100, order_by=None) -> DataFrame:
    """Rows at positions start..stop-1 of the given order.

    Early slices keep a small heap per task. For deep ones by plain columns the keys around both ends
    are found by selection, so that only rows between them are sorted and nothing is written; by
    other expressions the rows are numbered by range.
    """
    order = require_order(order_by, "A slice")
    if stop <= SHALLOW_SLICE:  # the same rows in the same order, at less cost
        return df.orderBy(*order).limit(stop).offset(start)
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if all(isinstance(n, str) and isinstance(df.schema[n].dataType, SELECTED_TYPES) for n in names):
        return _selected(df, names, start, stop)
    place = fresh_name(df, "__place")
    numbered = with_row_index(df, order, place)
    return numbered.where((F.col(place) >= start) & (F.col(place) < stop)).orderBy(place).drop(place)


def _selected(df: DataFrame, names: list[str], start: int, stop: int) -> DataFrame:
    """A deep slice between two keys with few rows between them.

    A sample of the keys guesses them, a count over all rows checks that the slice lies between, and
    this goes on within until few enough are left. A wrong guess costs a scan, never a row.
    """
    key, types = F.struct(*[col(n).alias(f"k{i}") for i, n in enumerate(names)]), [df.schema[n].dataType for n in names]

    def literal(values) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types))])

    def between(low, high) -> Column:
        kept = F.lit(True)
        if low is not None:
            kept = kept & (key >= literal(low))
            if low[0] is not None:  # a scan can skip row groups by it
                kept = kept & (col(names[0]) >= F.lit(low[0]).cast(types[0]))
        if high is not None:
            kept = kept & (key <= literal(high))
            if high[0] is not None:
                first = col(names[0])
                kept = kept & (first.isNull() | (first <= F.lit(high[0]).cast(types[0])))
        return kept

    low, high, below, inside = None, None, 0, df.count()
    stop, spread = min(stop, inside), 3.0
    while start < stop and inside > max(4 * (stop - start), SELECTED_ROWS):
        within = df.where(between(low, high)).select(key.alias("key"))
        drawn = within.sample(min(1.0, SELECTED_SAMPLE / inside), seed=len(names)).orderBy("key").limit(4 * SELECTED_SAMPLE).collect()
        margin = spread * math.sqrt(len(drawn)) + 1
        first, last = (len(drawn) * (r - below) / inside for r in (start, stop))
        new_low = tuple(drawn[int(first - margin)].key) if first - margin >= 0 else low
        new_high = tuple(drawn[math.ceil(last + margin)].key) if last + margin < len(drawn) - 1 else high
        if (new_low, new_high) == (low, high):
            break
        counted = df.agg(
            F.count_if(key < literal(new_low)).alias("below") if new_low is not None else F.lit(0).alias("below"), F.count_if(between(new_low, new_high)).alias("inside")
        ).first()
        if counted["below"] <= start and stop <= counted["below"] + counted["inside"]:
            if counted["inside"] == inside:
                break
            low, high, below, inside = new_low, new_high, counted["below"], counted["inside"]
        else:
            spread *= 2
    kept = df.where(between(low, high)) if low is not None or high is not None else df
    return kept.orderBy(*[col(n) for n in names]).limit(max(stop - below, 0)).offset(start - below)


def preview(df: DataFrame, n: int = 100, order_by=None) -> DataFrame:
    """First n rows; in no particular order unless one is given."""
    return df.orderBy(*require_order(order_by, "A preview")).limit(n) if order_by is not None else df.limit(n)


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The n most frequent values of each column: (column, value, count, rank)."""
    melted = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
        ).alias("m")
    ).select("m.*")
    counts = melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(
        Window.partitionBy("column").orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    )
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


JOINS = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "full": "full",
    "outer": "full",
    "left outer": "left",
    "right outer": "right",
    "full outer": "full",
    "semi": "left_semi",
    "anti": "left_anti",
}


def join_tables(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys.

    Right-side names already taken get the first free suffix of ``_right``, ``_right2``, ``_right3`` ...
    """
    keys = [on] if isinstance(on, str) else list(on or [])
    if right is None or not keys:
        raise ValueError("Name the other table and the columns to match on.")
    kind = JOINS.get(how.strip().lower())
    if kind is None:
        raise ValueError(f"Unknown join type: {how}")
    for k in keys:
        require_column(left, k)
        require_column(right, k)
    taken, names = {c.lower() for c in left.columns}, {}
    others = {c.lower() for c in right.columns} - taken
    for c in right.columns:
        names[c], i = c, 1
        while names[c].lower() in taken or (names[c] != c and names[c].lower() in others):
            names[c], i = f"{c}_right{i if i > 1 else ''}", i + 1
        taken.add(names[c].lower())
    renamed = right.select(*[col(c).alias(names[c]) for c in right.columns])
    condition = [left[quoted(k)] == renamed[quoted(names[k])] for k in keys]
    return left.join(renamed, condition, kind)


AGGREGATES = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
    "stddev": F.stddev_samp,
}


def aggregate(
    df: DataFrame,
    by: str | list[str] = (),
    function: str = "count",
    on: str | None = None,
    having: str | None = None,
    columns: list[str] = (),
    order_by=None,
) -> DataFrame:
    """One aggregate per group, largest first: column ``<function>_<on>``, ``count_all`` for rows.

    ``columns`` are carried along from the first row of each group under ``order_by``.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if function not in AGGREGATES:
        raise ValueError(f"Unknown aggregate: {function}")
    if on in (None, "*"):
        if function != "count":
            raise ValueError(f"{function} needs a column")
        measure, name = F.count(F.lit(1)), "count_all"
    else:
        measure, name = AGGREGATES[function](col(on)), f"{function}_{on}"
    carried: list[Column] = []
    if columns:
        order = require_order(order_by, "Carrying columns through a group")
        first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[col(c) for c in columns]))
        carried = [first.alias("__first")]
    out = df.groupBy(*[col(k) for k in keys]).agg(measure.alias(name), *carried)
    if columns:
        out = out.select(*[col(k) for k in keys], *[F.col("__first")[c].alias(c) for c in columns], col(name))
    if having:
        out = out.where(having)
    return out.orderBy(col(name).desc_nulls_last()) if keys else out


def union_tagged(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of several tables, matched by column name, with the table's name in ``tag``."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
