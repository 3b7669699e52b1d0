"""Remove rows whose value lies far from the rest of a numeric column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.statistics import nearest_quantiles
from burnish.functions.types import col, is_numeric, require_column
from burnish.operators.outcome import Outcome, rows_removed


def iqr_fences(df: DataFrame, columns: list[str], threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column from exact nearest-rank quartiles."""
    fences = {}
    for c, (q1, q3) in nearest_quantiles(df, columns, [0.25, 0.75]).items():
        q1, q3 = float(q1), float(q3)
        fences[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    return fences


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> Outcome:
    """Keep rows within the fences (``iqr``) or within threshold deviations (``zscore``), and nulls."""
    if not is_numeric(require_column(df, column)):
        raise ValueError(f"Column '{column}' is not numeric.")
    keep: Column | None = None
    if method == "iqr":
        fences = iqr_fences(df, [column], threshold)
        if column in fences:
            keep = col(column).between(*fences[column])
    elif method == "zscore":
        mean, deviation = df.agg(F.avg(col(column)).cast("double"), F.stddev_samp(col(column))).first()
        if deviation:
            keep = F.abs((col(column) - F.lit(mean)) / F.lit(deviation)) <= threshold
    else:
        raise ValueError(f"Unknown method: {method}. Use 'iqr' or 'zscore'.")
    after = df.filter(col(column).isNull() | keep) if keep is not None else df
    return Outcome(
        after,
        "remove_outliers",
        rows_removed(df, after) if keep is not None else None,
        {"column": column, "method": method, "threshold": threshold},
        "Removed {rows_affected:,} outlier rows from '{column}' ({method}, threshold={threshold}).",
    )
