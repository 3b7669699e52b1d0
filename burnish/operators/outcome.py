"""What a cleaning operator returns: a lazy table and lazily computed metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.types import col


@dataclass
class Outcome:
    """Cleaned table, what was done, and a one-row ``metrics`` frame holding rows_affected.

    Nothing runs until the table or the metrics are used.
    """

    df: DataFrame
    operation: str
    metrics: DataFrame | None = None
    details: dict = field(default_factory=dict)
    template: str = ""

    @cached_property
    def _measured(self) -> dict:
        return self.metrics.first().asDict() if self.metrics is not None else {}

    @property
    def rows_affected(self) -> int:
        return self._measured.get("rows_affected") or 0

    @property
    def description(self) -> str:
        return self.described()

    def described(self, rows_affected: int | None = None) -> str:
        """The description; with a number that is known already nothing is measured."""
        measured = {} if rows_affected is not None else self._measured
        known = self.rows_affected if rows_affected is None else rows_affected
        return self.template.format(**{**self.details, **measured, "rows_affected": known})


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_affected = rows before - rows after, in one job over both."""
    n = F.count(F.lit(1)).alias("n")
    return before.agg(n).unionAll(after.agg((-F.count(F.lit(1))).alias("n"))).agg(F.sum("n").alias("rows_affected"))


def distinct_values(c: Column) -> Column:
    """Number of distinct values, null counted as one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def cells_changed(before: Column, after: Column) -> Column:
    """Cells that differ; a null on either side is not counted."""
    return F.count_if(before != after)


def hashed(c: Column) -> Column:
    """128 bits that stand for a value; null has its own."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"), c.isNull().alias("none"))


def column_change(df: DataFrame, name: str, after: Column) -> DataFrame:
    """Distinct values before and after a column-wise change, and cells changed, in one pass over hashes."""
    changed = F.coalesce((col(name) != after).cast("long"), F.lit(0).cast("long"))
    before = F.struct(F.lit(True).alias("before"), hashed(col(name)).alias("h"), changed.alias("changed"))
    entries = F.array(before, F.struct(F.lit(False).alias("before"), hashed(after).alias("h"), F.lit(0).cast("long").alias("changed")))
    seen = df.select(F.explode(entries).alias("e")).groupBy("e.before", "e.h").agg(F.sum("e.changed").alias("changed"))
    return seen.agg(
        F.count_if("before").alias("before_unique"),
        F.count_if(~F.col("before")).alias("after_unique"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("rows_affected"),
    )
