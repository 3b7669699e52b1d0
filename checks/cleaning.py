"""Standardisation, format repair, null filling and outliers."""

from pyspark.sql import functions as F

from burnish.functions.text import composite_text
from burnish.operators import columns as cols
from burnish.operators import impute, nulls, outliers
from checks.registry import DIRTY_CUSTOMER, GAPPY_EVENTS, GAPPY_LINEITEM, query, table, view

# -- F: casing and formats ------------------------------------------------------------------

query("f1_lowercase", "SELECT doc_id, lower(text) AS text FROM documents")(
    lambda spark, sf: cols.change_case(table(spark, sf, "documents").select("doc_id", "text"), "text", "lowercase").df
)
# Upper-casing gives SS for the German sharp s; the SQL engine has a capital letter for it.
query("f2_uppercase", "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS text FROM documents")(
    lambda spark, sf: cols.change_case(table(spark, sf, "documents").select("doc_id", "text"), "text", "uppercase").df
)
query(
    "f3_titlecase",
    r"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'),
          lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || lower(w[2:])), '') AS text FROM conversations""",
)(
    lambda spark, sf: cols.change_case(
        table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", "titlecase"
    ).df
)


@query(
    "f4_standardize_metrics",
    f"""SELECT count(DISTINCT b) + max(CAST(b IS NULL AS INT)) AS before_unique, count(DISTINCT lower(b)) + max(CAST(b IS NULL AS INT)) AS after_unique,
               count_if(b <> lower(b)) AS rows_affected FROM (SELECT c_mktsegment AS b FROM ({DIRTY_CUSTOMER}))""",
)
def f4(spark, sf):
    return cols.change_case(view(spark, sf, DIRTY_CUSTOMER), "c_mktsegment", "lowercase").metrics


@query("f5_fix_emails", f"SELECT c_custkey, c_name, c_mktsegment, lower(trim(c_email)) AS c_email FROM ({DIRTY_CUSTOMER})")
def f5(spark, sf):
    df = view(spark, sf, DIRTY_CUSTOMER).select("c_custkey", "c_name", "c_mktsegment", "c_email")
    return cols.fix_formats(df, format_type="emails").df


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "f6_fix_whitespace",
    f"SELECT c_custkey, {_STRIP.format('c_name')} AS c_name, c_mktsegment, {_STRIP.format('c_email')} AS c_email FROM ({DIRTY_CUSTOMER})",
)
def f6(spark, sf):
    df = view(spark, sf, DIRTY_CUSTOMER).select("c_custkey", "c_name", "c_mktsegment", "c_email")
    return cols.fix_formats(df, format_type="whitespace").df


@query(
    "f7_fix_auto",
    f"""SELECT c_custkey, {_STRIP.format('c_name')} AS c_name, c_mktsegment, lower({_STRIP.format('c_email')}) AS c_email
        FROM ({DIRTY_CUSTOMER})""",
)
def f7(spark, sf):
    df = view(spark, sf, DIRTY_CUSTOMER).select("c_custkey", "c_name", "c_mktsegment", "c_email")
    return cols.fix_formats(df).df


@query(
    "f7_fix_auto_metrics",
    f"""SELECT count_if(c_name <> {_STRIP.format('c_name')}) + count_if(c_email <> lower({_STRIP.format('c_email')})) AS rows_affected
        FROM ({DIRTY_CUSTOMER})""",
)
def f7_metrics(spark, sf):
    return cols.fix_formats(view(spark, sf, DIRTY_CUSTOMER)).metrics.select("rows_affected")


@query(
    "f7_fix_auto_by_column",
    f"""SELECT 'c_name' AS column_name, count_if(c_name <> {_STRIP.format('c_name')}) AS cells FROM ({DIRTY_CUSTOMER}) UNION ALL
        SELECT 'c_email', count_if(c_email <> lower({_STRIP.format('c_email')})) FROM ({DIRTY_CUSTOMER}) UNION ALL
        SELECT 'c_mktsegment', count_if(c_mktsegment <> {_STRIP.format('c_mktsegment')}) FROM ({DIRTY_CUSTOMER})""",
)
def f7_by_column(spark, sf):
    return cols.fix_formats(view(spark, sf, DIRTY_CUSTOMER)).metrics.select(F.explode("by_column").alias("column_name", "cells"))


_DATES = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN {a} WHEN 'O' THEN {b} ELSE 'pending' END AS day FROM {orders}"""


@query(
    "f8_fix_dates",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'pending' END AS day FROM orders""",
)
def f8_dates(spark, sf):
    sql = _DATES.replace("{a}", "date_format(o_orderdate, 'yyyy/MM/dd')").replace("{b}", "date_format(o_orderdate, 'dd/MM/yyyy')")
    return cols.fix_formats(view(spark, sf, sql), "day", "dates").df

# E-mails appear only after the first thousand rows.
_LATE_MAIL = "SELECT event_id, CASE WHEN 10 * event_id > 9 * (SELECT max(event_id) FROM {events}) THEN concat(' U', CAST(user_id AS STRING), '@Mail.COM') ELSE 'None' END AS contact FROM {events}"


@query("f5_late_emails", f"SELECT event_id, lower(trim(contact)) AS contact FROM ({_LATE_MAIL})")
def f5_late(spark, sf):
    return cols.fix_formats(view(spark, sf, _LATE_MAIL), format_type="emails").df


@query("f8_fix_phones", "SELECT c_custkey, '+' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone FROM customer")
def f8_phones(spark, sf):
    raw = """SELECT c_custkey, concat('+', substr(k, 1, 3), '-', substr(k, 4, 3), ' (', substr(k, 7, 3), ')') AS phone
             FROM (SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 9, '0') AS k FROM {customer})"""
    return cols.fix_formats(view(spark, sf, raw), "phone", "phones").df


@query(
    "f9_text_to_number",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value
       FROM events""",
)
def f9(spark, sf):
    text = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS STRING) END AS value FROM {events}"
    return view(spark, sf, text).withColumn("value", F.col("value").try_cast("double"))


@query(
    "d4_composite_text",
    f"""SELECT c_custkey, coalesce(c_name, '') || ' | ' || coalesce(CAST(c_nationkey AS VARCHAR), '') || ' | '
               || coalesce(c_mktsegment, '') AS composite FROM ({DIRTY_CUSTOMER})""",
)
def d4(spark, sf):
    df = view(spark, sf, DIRTY_CUSTOMER)
    return df.select("c_custkey", composite_text(["c_name", "c_nationkey", "c_mktsegment"]).alias("composite"))


# -- N: nulls -------------------------------------------------------------------------------

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_shipdate"


@query(
    "n1_fill_mean",
    f"""SELECT {_KEYS}, round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity,
               round(coalesce(CAST(l_suppkey AS DOUBLE), avg(l_suppkey) OVER ()), 6) AS l_suppkey, l_returnflag FROM ({GAPPY_LINEITEM})""",
)
def n1(spark, sf):
    df = nulls.fill_nulls(view(spark, sf, GAPPY_LINEITEM), strategy="mean").df
    return df.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_suppkey")})


@query(
    "n2_fill_median",
    f"""SELECT {_KEYS}, coalesce(l_quantity, median(l_quantity) OVER ()) AS l_quantity,
               coalesce(CAST(l_suppkey AS DOUBLE), median(l_suppkey) OVER ()) AS l_suppkey, l_returnflag FROM ({GAPPY_LINEITEM})""",
)
def n2(spark, sf):
    return nulls.fill_nulls(view(spark, sf, GAPPY_LINEITEM), strategy="median").df


def _mode(column: str, source: str) -> str:
    return f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "n3_fill_mode",
    f"""WITH g AS ({GAPPY_LINEITEM}) SELECT {_KEYS}, coalesce(l_quantity, {_mode('l_quantity', 'g')}) AS l_quantity,
               coalesce(l_suppkey, {_mode('l_suppkey', 'g')}) AS l_suppkey,
               coalesce(l_returnflag, {_mode('l_returnflag', 'g')}) AS l_returnflag FROM g""",
)
def n3(spark, sf):
    return nulls.fill_nulls(view(spark, sf, GAPPY_LINEITEM), strategy="mode").df


@query(
    "n4_fill_forward",
    f"""SELECT event_id, ts, user_id, event_type,
               last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM ({GAPPY_EVENTS})""",
)
def n4(spark, sf):
    return nulls.fill_nulls(view(spark, sf, GAPPY_EVENTS), strategy="forward", order_by="event_id").df


@query(
    "n4_fill_forward_by_key",
    f"""SELECT event_id, ts, user_id, event_type,
               last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value
        FROM ({GAPPY_EVENTS})""",
)
def n4_key(spark, sf):
    df = view(spark, sf, GAPPY_EVENTS)
    return nulls.fill_nulls(df, "value", "forward", order_by=["ts", "event_id"], partition_by=["user_id"]).df


@query(
    "n4_fill_forward_hot_key",
    f"""SELECT event_id, ts, user_id, event_type,
               last_value(value IGNORE NULLS) OVER (PARTITION BY event_type = 'view' ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value,
               event_type = 'view' AS viewed FROM ({GAPPY_EVENTS})""",
)
def n4_hot(spark, sf):
    # Two keys only: each is spread over several ranges.
    df = view(spark, sf, GAPPY_EVENTS).withColumn("viewed", F.col("event_type") == "view")
    return nulls.fill_nulls(df, "value", "forward", order_by="event_id", partition_by=["viewed"]).df


@query(
    "n5_fill_zero",
    f"""SELECT {_KEYS}, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_suppkey, 0) AS l_suppkey,
               coalesce(l_returnflag, '') AS l_returnflag FROM ({GAPPY_LINEITEM})""",
)
def n5(spark, sf):
    return nulls.fill_nulls(view(spark, sf, GAPPY_LINEITEM), strategy="zero").df


@query(
    "n6_fill_metrics",
    f"SELECT count_if(l_quantity IS NULL) + count_if(l_suppkey IS NULL) AS rows_affected FROM ({GAPPY_LINEITEM})",
)
def n6(spark, sf):
    # Only numbers have a mean, so the text column's gaps do not count.
    return nulls.fill_nulls(view(spark, sf, GAPPY_LINEITEM), strategy="mean").metrics


GAPPY_PART = """
  SELECT p_partkey,
         CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_size END AS p_size,
         CASE WHEN p_brand IN ('Brand#2', 'Brand#17') THEN NULL ELSE p_retailprice END AS p_retailprice,
         p_name
  FROM {part}"""

# Nearest rows by the sum of squares over the columns both rows have, scaled to three columns.
_NEAREST = f"""
WITH r AS ({GAPPY_PART}),
     t AS (SELECT count_if(p_size IS NOT NULL AND p_retailprice IS NOT NULL) AS complete FROM r),
     d AS (SELECT a.p_partkey AS id, b.p_partkey AS donor, b.p_size, b.p_retailprice,
             (3.0 / (1 + CAST(a.p_size IS NOT NULL AND b.p_size IS NOT NULL AS INT)
                       + CAST(a.p_retailprice IS NOT NULL AND b.p_retailprice IS NOT NULL AS INT)))::DOUBLE
             * ((a.p_partkey - b.p_partkey)::DOUBLE * (a.p_partkey - b.p_partkey)::DOUBLE
                + coalesce((a.p_size - b.p_size)::DOUBLE * (a.p_size - b.p_size)::DOUBLE, 0)
                + coalesce((a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice), 0)) AS dist
           FROM r a, r b WHERE a.p_size IS NULL OR a.p_retailprice IS NULL),
     s AS (SELECT id, avg(p_size) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS n
             FROM d WHERE p_size IS NOT NULL) WHERE n <= 5 GROUP BY id),
     p AS (SELECT id, avg(p_retailprice) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS n
             FROM d WHERE p_retailprice IS NOT NULL) WHERE n <= 5 GROUP BY id)
SELECT p_partkey, CAST(coalesce(p_size, round(s.v)) AS INTEGER) AS p_size,
       round(coalesce(p_retailprice, p.v), 4) AS p_retailprice, p_name
FROM r LEFT JOIN s ON s.id = p_partkey LEFT JOIN p ON p.id = p_partkey"""


@query("n7_fill_nearest_rows", _NEAREST)
def n7(spark, sf):
    out = impute.fill_nulls_ml(view(spark, sf, GAPPY_PART), n_neighbors=5, order_by="p_partkey").df
    return out.withColumn("p_retailprice", F.round("p_retailprice", 4))


# A forest predicts means of observed values: gaps are filled within their range, the rest is left alone.
@query("n8_fill_forest", "SELECT c_custkey, c_mktsegment = 'BUILDING' AS filled, true AS fits FROM customer")
def n8(spark, sf):
    sql = "SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal FROM {customer}"
    df = view(spark, sf, sql)
    filled = impute.fill_nulls_ml(df, "c_acctbal", "rf", order_by="c_custkey").df
    low, high = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    both = filled.select("c_custkey", F.col("c_acctbal").alias("now")).join(df.select("c_custkey", F.col("c_acctbal").alias("was")), "c_custkey")
    fits = F.coalesce(F.col("now") == F.col("was"), F.col("now").between(low, high))
    return both.select("c_custkey", F.col("was").isNull().alias("filled"), F.coalesce(fits, F.lit(False)).alias("fits"))


@query(
    "n9_fill_fallback",
    f"""WITH g AS (SELECT event_type, value FROM ({GAPPY_EVENTS}))
        SELECT event_type, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM g""",
)
def n9(spark, sf):
    # One numeric column: no other to learn from.
    df = view(spark, sf, GAPPY_EVENTS).select("event_type", "value")
    return impute.fill_nulls_ml(df).df.withColumn("value", F.round("value", 6))


@query(
    "n10_fill_report",
    f"""SELECT 'p_size' AS "column", count(*) AS filled, 'knn' AS method FROM ({GAPPY_PART}) WHERE p_size IS NULL
        UNION ALL SELECT 'p_retailprice', count(*), 'knn' FROM ({GAPPY_PART}) WHERE p_retailprice IS NULL""",
)
def n10(spark, sf):
    before = view(spark, sf, GAPPY_PART)
    after = impute.fill_nulls_ml(before, n_neighbors=3, order_by="p_partkey").df
    return impute.fill_report(before, after, ["p_size", "p_retailprice"], "knn")


# -- O: outliers ----------------------------------------------------------------------------

def nearest(column: str, q: float) -> str:
    """Nearest-rank quantile in SQL: the sorted value at index round((n - 1) q)."""
    at = f"CAST(floor((count({column}) - 1) * {q} + 0.5) AS BIGINT) + 1"
    return f"list_extract(list_sort(list({column}) FILTER ({column} IS NOT NULL)), {at})"


def fences(column: str, source: str, t: float = 1.5) -> str:
    return f"""SELECT q1 - {t} * (q3 - q1) AS lo, q3 + {t} * (q3 - q1) AS hi
               FROM (SELECT {nearest(column, 0.25)} AS q1, {nearest(column, 0.75)} AS q3 FROM {source})"""


@query("o1_outliers_iqr", f"SELECT events.* FROM events, ({fences('value', 'events')}) WHERE value BETWEEN lo AND hi")
def o1(spark, sf):
    return outliers.remove_outliers(table(spark, sf, "events"), "value").df


@query(
    "o1_outliers_iqr_tight",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem,
        ({fences('l_extendedprice', 'lineitem', 0.2)}) WHERE l_extendedprice BETWEEN lo AND hi""",
)
def o1_tight(spark, sf):
    df = outliers.remove_outliers(table(spark, sf, "lineitem"), "l_extendedprice", "iqr", 0.2).df
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "o2_outliers_zscore",
    f"""WITH g AS ({GAPPY_EVENTS}) SELECT g.* FROM g, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM g)
        WHERE value IS NULL OR abs((value - m) / s) <= 1.5""",
)
def o2(spark, sf):
    return outliers.remove_outliers(view(spark, sf, GAPPY_EVENTS), "value", "zscore", 1.5).df


@query(
    "o3_outliers_removed",
    f"SELECT count(*) AS rows_affected FROM events, ({fences('value', 'events')}) WHERE value < lo OR value > hi",
)
def o3(spark, sf):
    return outliers.remove_outliers(table(spark, sf, "events"), "value").metrics
