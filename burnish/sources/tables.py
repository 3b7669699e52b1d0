"""Tables of the session catalog or of a JDBC database behind one interface."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.types import col, quoted


@dataclass(frozen=True)
class Connection:
    """Where tables live: a JDBC url with its options, or (no url) the session catalog.

    For large JDBC tables put partitionColumn, lowerBound, upperBound and numPartitions into
    ``options``; without them Spark reads a table over one connection.
    """

    url: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**self.options)


CATALOG = Connection()


def read_table(
    spark: SparkSession,
    table: str,
    connection: Connection = CATALOG,
    schema: str | None = None,
    columns: list[str] | None = None,
    where: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Scan a table; columns, predicate and row cap are left to the source's pushdown."""
    if connection.url:
        name = f"{schema}.{table}" if schema else table
        df = connection.reader(spark).option("dbtable", name).load()
    else:
        df = spark.table(f"{quoted(schema)}.{quoted(table)}" if schema else quoted(table))
    if where:
        df = df.where(where)
    if columns:
        df = df.select(*[col(c) for c in columns])
    return df.limit(limit) if limit is not None else df


def read_query(spark: SparkSession, sql: str, connection: Connection = CATALOG) -> DataFrame:
    """Result of a SQL query; the JDBC database runs it if there is one."""
    if connection.url:
        return connection.reader(spark).option("query", sql).load()
    return spark.sql(sql)


def read_tables(
    spark: SparkSession,
    tables: list[str],
    connection: Connection = CATALOG,
    schema: str | None = None,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    return {t: read_table(spark, t, connection, schema, limit=limit) for t in tables}


MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_table(
    df: DataFrame,
    table: str,
    connection: Connection = CATALOG,
    if_exists: str = "replace",
    path: str | None = None,
    schema: str | None = None,
) -> None:
    """Write to a JDBC table, or to a catalog table (in ``schema``) whose files go to ``path``."""
    if if_exists not in MODES:
        raise ValueError(f"Unknown if_exists: {if_exists}")
    writer = df.write.mode(MODES[if_exists])
    if connection.url:
        writer.format("jdbc").option("url", connection.url).options(**connection.options).option(
            "dbtable", f"{schema}.{table}" if schema else table
        ).save()
    else:
        if path:
            writer = writer.option("path", path)
        writer.format("parquet").saveAsTable(f"{quoted(schema)}.{quoted(table)}" if schema else quoted(table))


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One line per column of each table: type, nullability, and the table's row count."""
    parts = []
    for name, df in tables.items():
        fields = F.array(
            *[
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("column_type"),
                    F.lit(f.nullable).alias("nullable"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(
            counted.select(F.lit(name).alias("table_name"), "row_count", F.explode(fields).alias("f")).select(
                "table_name", "f.*", "row_count"
            )
        )
    return reduce(DataFrame.unionAll, parts)


def get_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """describe_tables over every table and view the session catalog lists, and whether it is a view."""
    listed = spark.catalog.listTables(schema) if schema else spark.catalog.listTables()
    names = [t.name for t in listed]
    if not names:
        return spark.createDataFrame(
            [],
            "table_name string, ordinal int, column_name string, column_type string, nullable boolean, row_count long, is_view boolean",
        )
    views = [t.name for t in listed if t.isTemporary or t.tableType == "VIEW"]
    inside = {t.name: None if t.isTemporary else schema for t in listed}
    described = describe_tables({n: read_table(spark, n, schema=inside[n]) for n in names})
    return described.withColumn("is_view", F.col("table_name").isin(views))
