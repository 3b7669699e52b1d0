"""A table described as DDL, with layout hints, from one aggregate and one count of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.types import col, is_text
from burnish.operators.profile import distinct_counts

# SQL type names by engine.
POSTGRESQL = {
    T.ByteType: "SMALLINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "REAL",
    T.DoubleType: "DOUBLE PRECISION",
    T.StringType: "VARCHAR(255)",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
    T.DayTimeIntervalType: "INTERVAL",
}
MYSQL = {**POSTGRESQL, T.DoubleType: "DOUBLE", T.BooleanType: "TINYINT(1)"}
SQLITE = {
    **POSTGRESQL,
    T.ByteType: "INTEGER",
    T.ShortType: "INTEGER",
    T.LongType: "INTEGER",
    T.DoubleType: "REAL",
    T.StringType: "TEXT",
    T.DateType: "TEXT",
    T.TimestampType: "TEXT",
    T.TimestampNTZType: "TEXT",
}
ENGINES = {"postgresql": POSTGRESQL, "mysql": MYSQL, "sqlite": SQLITE}
LOW_CARDINALITY = 0.1
#: The longest text that is declared with a length; columns with longer ones are TEXT.
LONGEST = 255


def sql_type(dtype: T.DataType, engine: str = "postgresql") -> str:
    return ENGINES.get(engine, POSTGRESQL).get(type(dtype), "TEXT")


def ddl_profile(df: DataFrame, engine: str = "postgresql", exact: bool = True) -> DataFrame:
    """One line per column: ordinal, name, SQL type, nullability, layout hint.

    Nullability is what the data shows. A hinted column (named like an id, a date, or text with
    few values, null as one) is worth bucketing or partitioning by. Distinct counts come from one pass
    over hashes; ``exact=False`` estimates them in the same aggregate as the rest.
    """
    fields = df.schema.fields
    counts = []
    worded = [f.name for f in fields if is_text(f.dataType) and "id" not in f.name.lower()]
    distinct = distinct_counts(df.select(*[col(c) for c in worded]), whole_rows=False) if exact and worded else {}
    for i, f in enumerate(fields):
        counts.append(F.count_if(col(f.name).isNull()).alias(f"n{i}"))
        if is_text(f.dataType):
            counts.append(F.coalesce(F.max(F.length(col(f.name))), F.lit(0)).alias(f"l{i}"))
        if f.name in worded:
            seen = F.lit(distinct[f.name]) if exact else F.approx_count_distinct(col(f.name))
            counts.append((seen + (F.count_if(col(f.name).isNull()) > 0).cast("int")).alias(f"u{i}"))
    measured = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    lines = []
    for i, f in enumerate(fields):
        if "id" in f.name.lower():
            hint = F.lit("key")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            hint = F.lit("time")
        elif is_text(f.dataType):
            hint = F.when(F.col(f"u{i}") < F.col("rows") * LOW_CARDINALITY, F.lit("category"))
        else:
            hint = F.lit(None).cast("string")
        declared = F.lit(sql_type(f.dataType, engine))
        if is_text(f.dataType):
            declared = F.when(F.col(f"l{i}") > LONGEST, "TEXT").otherwise(declared)
        lines.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                declared.alias("sql_type"),
                (F.col(f"n{i}") > 0).alias("nullable"),
                hint.alias("layout_hint"),
            )
        )
    return measured.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def create_table(df: DataFrame, table: str = "data", engine: str = "postgresql") -> str:
    """CREATE TABLE text with NOT NULL where no null was seen."""
    quote = "`" if engine == "mysql" else '"'
    lines = [
        f"    {quote}{r.column_name}{quote} {r.sql_type}" + ("" if r.nullable else " NOT NULL")
        for r in ddl_profile(df, engine, exact=False).orderBy("ordinal").collect()
    ]
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n);"
