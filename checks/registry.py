"""Collects queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the standard tables, written as {table} where one is read."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SELECT for the other engine."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = plain(sql)
        return fn

    return add


# -- derived input --------------------------------------------------------------------------

# Customers with gaps, case variants, padded text and an e-mail column.
DIRTY_CUSTOMER = """
  SELECT c_custkey,
         concat('  ', c_name, chr(9)) AS c_name,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_nationkey < 5 THEN lower(c_mktsegment) WHEN c_nationkey > 21 THEN NULL
              ELSE c_mktsegment END AS c_mktsegment,
         concat(' ', upper(c_name), '@Mail.COM') AS c_email
  FROM {customer}"""

# Line items with gaps in a measure, a whole number and a text column.
GAPPY_LINEITEM = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
         CASE WHEN l_linestatus = 'F' AND l_discount < 0.03 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_tax > 0.06 THEN NULL ELSE l_suppkey END AS l_suppkey,
         CASE WHEN l_quantity > 40 THEN NULL ELSE l_returnflag END AS l_returnflag
  FROM {lineitem}"""

# Events with gaps in the value.
GAPPY_EVENTS = """
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE value END AS value
  FROM {events}"""
