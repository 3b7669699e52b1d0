"""Which columns count as numbers or text, and how a caller names a row order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)

OrderBy = str | Column | Sequence[str | Column]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def quoted(name: str) -> str:
    """Column name as a Spark SQL identifier, so dots and blanks survive."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def as_columns(spec: OrderBy) -> list[Column]:
    items: Iterable = [spec] if isinstance(spec, (str, Column)) else spec
    return [col(i) if isinstance(i, str) else i for i in items]


def require_column(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"Column '{name}' not found in DataFrame.")
    return df.schema[name].dataType


def require_order(order_by: OrderBy | None, what: str) -> list[Column]:
    """A DataFrame has no row order, so position-based work must name one."""
    if order_by is None or (not isinstance(order_by, (str, Column)) and not list(order_by)):
        raise ValueError(f"{what} depends on row order: pass order_by (a unique key).")
    return as_columns(order_by)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name the frame does not use yet."""
    name = stem
    while name in df.columns:
        name += "_"
    return name
