"""Text expressions: repair, casing, composite keys, character statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.types import col, text_columns

COMPOSITE_SEPARATOR = " | "


def strip(c: Column) -> Column:
    """Remove white space of every kind (tabs, no-break spaces) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def titlecase(c: Column) -> Column:
    """Upper-case the first character of each run of letters and digits.

    Unlike ``initcap``, any other character starts a new word: ``o'neil`` gives ``O'Neil``.
    """
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    cased = F.transform(
        runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    )
    return F.array_join(cased, "")


def composite_text(columns: list[str]) -> Column:
    """The text a row is compared by: its columns as strings, nulls as ''."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(COMPOSITE_SEPARATOR, *parts)


def comparison_columns(df: DataFrame, subset: list[str] | None) -> list[str]:
    return list(subset) if subset is not None else text_columns(df)


def bucketize(c: Column, width: float) -> Column:
    """Lower edge of the bucket of the given width a number falls in, e.g. a decade."""
    return (F.floor(c / F.lit(width)) * F.lit(width)).cast("int")
