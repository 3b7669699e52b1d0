"""File sinks, and a table as a SQL script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.types import col, is_numeric


def sql_literal(name: str, dtype: T.DataType) -> Column:
    """A cell as a SQL literal: null, number, boolean, or quoted text with quotes doubled."""
    text = col(name).cast("string")
    if not is_numeric(dtype) and not isinstance(dtype, T.BooleanType):
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str = "data") -> DataFrame:
    """One INSERT statement per row, in a single column ``statement``."""
    names = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    values = F.concat_ws(", ", *[sql_literal(f.name, f.dataType) for f in df.schema.fields])
    return df.select(
        F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");")).alias("statement")
    )


def export(df: DataFrame, path: str, format: str = "csv", table: str = "data", mode: str = "errorifexists") -> str:
    """Write the table as csv, tsv, parquet, json (lines) or a sql script; one part per task."""
    writer = df.write.mode(mode)
    if format in ("csv", "tsv"):
        # Spaces around a text belong to it; an empty text is quoted and so told from null.
        writer.options(header=True, sep="," if format == "csv" else "\t", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif format == "parquet":
        writer.parquet(path)
    elif format in ("json", "jsonl"):
        writer.json(path)
    elif format == "sql":
        # The CREATE TABLE text is a file of its own: parts of a folder have no order.
        from burnish.operators.ddl import create_table

        df.sparkSession.createDataFrame([(create_table(df, table),)], "value string").coalesce(1).write.mode(
            mode
        ).option("lineSep", "\n").text(f"{path}/create")
        insert_statements(df, table).write.mode(mode).text(f"{path}/insert")
    else:
        raise ValueError(f"Unsupported export format: {format}")
    return path
