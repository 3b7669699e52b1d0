"""Column picks, row filters and per-column repairs. All are row-local."""

from __future__ import annotations

import operator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions import text as tx
from burnish.functions.types import col, is_numeric, is_text, require_column, text_columns
from burnish.operators.outcome import Outcome, cells_changed, column_change, rows_removed


def drop_columns(df: DataFrame, columns: list[str]) -> Outcome:
    """Drop columns; names the table does not have are ignored."""
    present = [c for c in columns if c in df.columns]
    return Outcome(
        df.drop(*present), "drop_columns", details={"columns": present}, template="Dropped columns: {columns}."
    )


def rename_column(df: DataFrame, old: str, new: str) -> Outcome:
    require_column(df, old)
    return Outcome(
        df.withColumnRenamed(old, new),
        "rename_column",
        details={"from": old, "to": new},
        template="Renamed '{from}' -> '{to}'.",
    )


def filter_rows(df: DataFrame, condition: str) -> Outcome:
    """Keep the rows for which a SQL predicate holds."""
    kept = df.filter(F.expr(condition))
    return Outcome(
        kept,
        "filter_rows",
        rows_removed(df, kept),
        {"condition": condition},
        "Filtered: {rows_affected:,} rows removed.",
    )


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        require_column(df, c)
    return df.select(*[col(c) for c in columns])


# -- grid filters and sort ------------------------------------------------------------------

NUMBER_TESTS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def grid_condition(column: str, op: str, value: str = "", dtype: T.DataType | None = None) -> Column:
    """One filter of the data grid: text tests ignore case and read null as ''.

    Number tests read the cell as a number; a cell that is not one never matches. On a number column
    they compare the column itself, which a scan can skip row groups by.
    """
    raw = F.coalesce(col(column).cast("string"), F.lit(""))
    cell, wanted = F.lower(raw), F.lit(value.strip().lower())
    typed = dtype is not None and is_numeric(dtype)
    if typed and op in NUMBER_TESTS:
        # A whole number keeps the column's type, so the comparison can be pushed down.
        wanted_number = float(value)
        return NUMBER_TESTS[op](col(column), int(wanted_number) if wanted_number.is_integer() else wanted_number)
    if typed and op in ("is_empty", "not_empty"):
        return col(column).isNull() if op == "is_empty" else col(column).isNotNull()
    number = raw.try_cast("double")
    tests = {
        "contains": lambda: cell.contains(wanted),
        "not_contains": lambda: ~cell.contains(wanted),
        "equals": lambda: cell == wanted,
        "not_equals": lambda: cell != wanted,
        "starts_with": lambda: cell.startswith(wanted),
        "ends_with": lambda: cell.endswith(wanted),
        **{name: lambda test=test: F.coalesce(test(number, float(value)), F.lit(False)) for name, test in NUMBER_TESTS.items()},
        "is_empty": lambda: tx.strip(raw) == "",
        "not_empty": lambda: tx.strip(raw) != "",
    }
    if op not in tests:
        raise ValueError(f"Unknown filter: {op}")
    return tests[op]()


def grid_sort(column: str, direction: str = "asc", dtype: T.DataType | None = None) -> list[Column]:
    """Sort keys of the data grid: numbers first by value, then the rest as text; a number column by itself."""
    if dtype is not None and is_numeric(dtype):
        return [col(column).asc_nulls_last() if direction == "asc" else col(column).desc_nulls_last()]
    number, raw = col(column).cast("string").try_cast("double"), F.coalesce(col(column).cast("string"), F.lit(""))
    if direction == "asc":
        return [number.asc_nulls_last(), raw.asc()]
    return [number.desc_nulls_last(), raw.desc()]


def grid_view(
    df: DataFrame, filters: list[tuple] = (), sort: tuple[str, str] | None = None
) -> DataFrame:
    """Rows that pass every (column, op, value) filter, sorted by one column."""
    if filters:
        df = df.filter(reduce(and_, [grid_condition(*f, dtype=df.schema[f[0]].dataType) for f in filters]))
    return df.orderBy(*grid_sort(*sort, dtype=df.schema[sort[0]].dataType)) if sort else df


# -- standardisation and format repair ------------------------------------------------------

CASINGS = {"lowercase": F.lower, "uppercase": F.upper, "titlecase": tx.titlecase}


def change_case(df: DataFrame, column: str, method: str) -> Outcome:
    """Rewrite a text column in one casing, row by row."""
    if not is_text(require_column(df, column)):
        raise ValueError(f"Column '{column}' is not a string column.")
    if method not in CASINGS:
        raise ValueError(f"Unknown method: {method}")
    after = CASINGS[method](col(column))
    return Outcome(
        df.withColumn(column, after),
        "standardize",
        column_change(df, column, after),
        {"column": column, "method": method},
        "Standardized '{column}': {before_unique} -> {after_unique} unique values, {rows_affected:,} cells changed.",
    )


def email_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with an '@' in any value, from one aggregate over all of them."""
    if not columns:
        return []
    found = df.agg(*[F.bool_or(col(c).contains("@")).alias(f"at{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if found[f"at{i}"]]


DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy"]


def iso_date(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """A date text in any of the formats as YYYY-MM-DD; other text stays as it is."""
    parsed = F.coalesce(*[F.try_to_date(tx.strip(c), f) for f in formats])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), c)


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9+]", "")


def fix_formats(
    df: DataFrame,
    column: str | None = None,
    format_type: str = "auto",
    date_formats: list[str] = DATE_FORMATS,
) -> Outcome:
    """Repair e-mails (lower-case, strip) and white space (strip) in text columns.

    A column counts as e-mails if any of its values has an '@'. ``dates`` and ``phones`` must be
    asked for by name. The metrics also hold the cells repaired ``by_column``.
    """
    names = [column] if column else text_columns(df)
    names = [c for c in names if c in df.columns and is_text(df.schema[c].dataType)]
    after: dict[str, Column] = {}
    emails = set(email_columns(df, names)) if format_type in ("auto", "emails") else set()
    for c in names:
        if c in emails:
            after[c] = tx.strip(F.lower(col(c)))
        elif format_type in ("auto", "whitespace"):
            after[c] = tx.strip(col(c))
        elif format_type == "dates":
            after[c] = iso_date(col(c), date_formats)
        elif format_type == "phones":
            after[c] = phone_digits(col(c))
    metrics = None
    if after:
        changed = [cells_changed(col(c), e) for c, e in after.items()]
        by_column = F.create_map(*[e for c, n in zip(after, changed) for e in (F.lit(c), n)])
        metrics = df.agg(reduce(lambda a, b: a + b, changed).alias("rows_affected"), by_column.alias("by_column"))
    return Outcome(
        df.withColumns(after) if after else df,
        "fix_formats",
        metrics,
        {"format_type": format_type, "column": column, "columns": list(after), "emails": sorted(emails)},
        "{rows_affected:,} cells repaired ({format_type}).",
    )
