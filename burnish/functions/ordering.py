"""Row positions and running values over a whole table, without a one-task sort.

Rows are range-partitioned by the wanted order and written once, each row tagged with its range.
A table of one line per range then carries whatever must cross from one range to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.functions.types import col, fresh_name


def in_ranges(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """The rows range-partitioned by ``order``; ``tag`` numbers the ranges in that order."""
    return stage(df.repartitionByRange(*order).withColumn(tag, F.spark_partition_id()), "ranges")


def with_rank(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """Add a long that grows with the order, not necessarily by one; ``order`` must be unique.

    Numbers are given out once, when the ranges are written, and read back from there. All rows stay,
    with the columns ``keep`` (by default all): others are neither shuffled nor written.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = ordered.withColumn(name, F.monotonically_increasing_id())
    return stage(ranked if keep is None else ranked.select(*map(col, keep), name), "ranked")


RANK_BITS = 33  # monotonically_increasing_id: range number above, position in the range below


def with_row_index(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """Add the 0-based position of each row in the given order, which must be unique; ``keep`` as in with_rank."""
    rank = fresh_name(df, "__rank")
    ranked = with_rank(df, order, rank, keep).withColumn("__range", F.shiftright(rank, RANK_BITS))
    # One line per range, so the running total fits one task however long the table is.
    counts = ranked.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col(rank).bitwiseAND((1 << RANK_BITS) - 1)
    return ranked.join(starts, "__range").withColumn(name, place.cast("long")).drop("__range", "__start", rank)
