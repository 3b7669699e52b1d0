"""Profiles, quality scores and DDL."""

from pyspark.sql import functions as F

from burnish.operators import ddl
from burnish.operators import profile as prof
from burnish.operators.profile_state import column_states, describe_states, merge_states
from burnish.sources import tables as tbl
from checks.cleaning import fences
from checks.duplicates import _NARROW
from checks.registry import DIRTY_CUSTOMER, GAPPY_LINEITEM, TABLES, plain, query, table, view

CUSTOMER_COLUMNS = {
    "c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text", "c_email": "text",
}
LINE_COLUMNS = {
    "l_orderkey": "number", "l_linenumber": "number", "l_partkey": "number", "l_shipdate": "other", "l_quantity": "number",
    "l_suppkey": "number", "l_returnflag": "text",
}
EVENT_COLUMNS = {"event_id": "number", "ts": "other", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}


def column_sql(source: str, columns: dict[str, str]) -> str:
    """One row per column with its counts and the issues that counts decide."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        number = kind == "number"
        far = f"(SELECT count(*) FROM ({source}), ({fences(c, f'({source})')}) WHERE {c} < lo OR {c} > hi)" if number else "NULL::BIGINT"
        casing = f"count(DISTINCT lower({c})) < count(DISTINCT {c})" if kind == "text" else "false"
        parts.append(
            f"""SELECT {i} AS ordinal, '{c}' AS name, count(*) AS n, count(*) - count({c}) AS null_count,
                count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) AS unique_count,
                {f'min({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS min_value, {f'max({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS max_value,
                {f'avg({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS mean_value, {far} AS outlier_count, {casing} AS mixed_case
                FROM ({source})"""
        )
    return f"""SELECT *, 100.0 * null_count / n AS null_pct, 100.0 * unique_count / n AS unique_pct,
        CAST(100.0 * null_count / n > 50 AS INT)
        + CAST(100.0 * unique_count / n > 95 AND unique_count < n AND contains(lower(name), 'id') AS INT)
        + CAST(mixed_case AS INT)
        + CAST(coalesce(outlier_count, 0) > 0 AS INT) AS issue_count
        FROM ({' UNION ALL '.join(parts)})"""


def score_sql(source: str, columns: dict[str, str]) -> str:
    """Quality score; dates are not looked at."""
    names = ", ".join(columns)
    return f"""
      SELECT n AS row_count, {len(columns)} AS col_count, duplicates AS duplicate_count,
             CAST(greatest(0, least(100, round_even(100.0 - least(100.0 * duplicates / n, 20) - least(0.6 * nulls, 30)
                  - least(5 * issues, 30) - 2 * flat, 0))) AS INTEGER) AS quality_score
      FROM (SELECT max(n) AS n, avg(null_pct) AS nulls, sum(issue_count) AS issues,
                   count_if(unique_pct < 1 AND null_pct < 50 AND NOT contains(lower(name), 'id')) AS flat
            FROM ({column_sql(source, columns)})),
           (SELECT (SELECT count(*) FROM ({source})) - count(*) AS duplicates FROM (SELECT DISTINCT {names} FROM ({source})))"""


_DIRTY = plain(DIRTY_CUSTOMER)
_GAPPY = plain(GAPPY_LINEITEM)
_EVENTS = "SELECT * FROM events"

SOURCES = {
    "customer": (DIRTY_CUSTOMER, _DIRTY, CUSTOMER_COLUMNS),
    "lineitem": (GAPPY_LINEITEM, _GAPPY, LINE_COLUMNS),
    "events": ("SELECT * FROM {events}", _EVENTS, EVENT_COLUMNS),
}
_SCORE = ["row_count", "col_count", "duplicate_count", "quality_score"]

for _name, (_spark, _sql, _columns) in SOURCES.items():

    @query(
        f"r3_r4_r6_r11_column_profile_{_name}",
        f"""SELECT ordinal, name, null_count, round(null_pct, 6) AS null_pct, unique_count, round(unique_pct, 6) AS unique_pct,
                   min_value, max_value, round(mean_value, 6) AS mean_value, outlier_count, issue_count
            FROM ({column_sql(_sql, _columns)})""",
    )
    def column_profile(spark, sf, source=_spark):
        out = prof.profile_columns(view(spark, sf, source))
        return out.select(
            "ordinal", "name", "null_count", F.round("null_pct", 6).alias("null_pct"), "unique_count",
            F.round("unique_pct", 6).alias("unique_pct"), F.col("min_value").cast("double").alias("min_value"),
            F.col("max_value").cast("double").alias("max_value"), F.round("mean_value", 6).alias("mean_value"), "outlier_count",
            F.size("issues").alias("issue_count"),
        )

    @query(f"r1_r12_quality_score_{_name}", score_sql(_sql, _columns))
    def score(spark, sf, source=_spark):
        return prof.profile(view(spark, sf, source)).select(*_SCORE)


@query(
    "r2_duplicate_rows",
    f"SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_count FROM (SELECT DISTINCT * FROM ({_NARROW}))",
)
def r2(spark, sf):
    return prof.duplicate_count(view(spark, sf, _NARROW))


@query(
    "r4_unique_long_texts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(DISTINCT {c}) AS unique_count FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
def r4_texts(spark, sf):
    return prof.profile_columns(table(spark, sf, "documents")).select("name", "unique_count")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


# Three standard errors of the estimate.
@query(
    "r4_unique_estimated",
    " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS unique_count, true AS close FROM lineitem" for c in _LINE),
)
def r4_estimated(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = prof.profile_columns(lines, approximate=True).select("name", F.col("unique_count").alias("estimate"))
    exact = prof.distinct_counts(lines, whole_rows=False)
    known = spark.createDataFrame([(c, exact[c]) for c in _LINE], "name string, unique_count long")
    return found.join(known, "name").select("name", "unique_count", (F.abs(F.col("estimate") - F.col("unique_count")) <= 0.15 * F.col("unique_count")).alias("close"))


_SAMPLED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "r5_sample_values",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, string_agg(v, '/' ORDER BY c_custkey) AS samples FROM (SELECT c_custkey, CAST({c} AS VARCHAR) AS v
            FROM ({_DIRTY}) WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5)"""
        for c in _SAMPLED
    ),
)
def r5(spark, sf):
    out = prof.profile_columns(view(spark, sf, DIRTY_CUSTOMER).select(*_SAMPLED), order_by="c_custkey")
    return out.select("name", F.array_join("sample_values", "/").alias("samples"))


def issues(df):
    """Column issues as text, one row per issue."""
    return df.select("name", F.explode("issues").alias("issue"))


_MOSTLY_NULL = "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN value END AS error_value FROM {events}"


@query(
    "r7_mostly_null",
    f"""SELECT 'error_value' AS name, format('{{:.0f}} % of the cells are null', 100.0 * count_if(error_value IS NULL) / count(*)) AS issue
        FROM ({_MOSTLY_NULL}) UNION ALL
        SELECT 'error_value', format('{{:,}} values lie beyond the quartile fences', count(*)) FROM ({_MOSTLY_NULL}),
        ({fences('error_value', f'({_MOSTLY_NULL})')}) WHERE error_value < lo OR error_value > hi HAVING count(*) > 0""",
)
def r7(spark, sf):
    return issues(prof.profile_columns(view(spark, sf, _MOSTLY_NULL)))


_NEAR_ID = "SELECT CASE WHEN value > 180 THEN event_id + 1 ELSE event_id END AS event_id, event_type FROM {events}"


@query(
    "r8_id_with_duplicates",
    f"""SELECT 'event_id' AS name, format('named like a key, but {{:,}} rows repeat one', count(*) - count(DISTINCT event_id)) AS issue FROM ({_NEAR_ID})
        HAVING count(DISTINCT event_id) < count(*) AND count(DISTINCT event_id) > 0.95 * count(*)""",
)
def r8(spark, sf):
    return issues(prof.profile_columns(view(spark, sf, _NEAR_ID)))


@query(
    "r9_inconsistent_casing",
    f"""SELECT 'c_mktsegment' AS name, count(DISTINCT c_mktsegment) || ' spellings, ' || count(DISTINCT lower(c_mktsegment)) || ' without regard to casing' AS issue
        FROM ({DIRTY_CUSTOMER}) HAVING count(DISTINCT lower(c_mktsegment)) < count(DISTINCT c_mktsegment)""",
)
def r9(spark, sf):
    return issues(prof.profile_columns(view(spark, sf, DIRTY_CUSTOMER).select("c_mktsegment")))


# Gaps but one casing: an issue only in the compatible reading.
_ONE_CASE = "SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM {customer}"


@query(
    "r9_casing_compatible",
    f"""SELECT 'c_mktsegment' AS name, (count(DISTINCT c_mktsegment) + 1) || ' spellings, ' || count(DISTINCT c_mktsegment) || ' without regard to casing' AS issue
        FROM ({_ONE_CASE})""",
)
def r9_compatible(spark, sf):
    return issues(prof.profile_columns(view(spark, sf, _ONE_CASE), compatible=True))


_TWO_DATES = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN {a} ELSE {b} END AS day FROM {orders}"""
_FIRST_DAYS = _TWO_DATES.replace("{a}", "strftime(o_orderdate, '%Y-%m-%d')").replace("{b}", "strftime(o_orderdate, '%Y/%m/%d')")


@query(
    "r10_mixed_dates",
    f"""SELECT 'day' AS name, 'dates are written as ' || string_agg(layout, ' and ' ORDER BY layout) AS issue
        FROM (SELECT DISTINCT CASE WHEN contains(day, '/') THEN 'YYYY/MM/DD' ELSE 'YYYY-MM-DD' END AS layout
              FROM ({_FIRST_DAYS})) HAVING count(*) > 1""",
)
def r10(spark, sf):
    sql = _TWO_DATES.replace("{a}", "date_format(o_orderdate, 'yyyy-MM-dd')").replace("{b}", "date_format(o_orderdate, 'yyyy/MM/dd')")
    return issues(prof.profile_columns(view(spark, sf, sql), order_by="o_orderkey").where("name = 'day'"))


_LATE_DAYS = """SELECT o_orderkey, CASE WHEN o_orderkey <= 1000 THEN {a} ELSE {b} END AS day FROM {orders}"""


@query(
    "r10_dates_change_late",
    """SELECT 'day' AS name, 'dates are written as YYYY-MM-DD and YYYY/MM/DD' AS issue FROM orders
       HAVING count_if(o_orderkey <= 1000) > 0 AND count_if(o_orderkey > 1000) > 0""",
)
def r10_late(spark, sf):
    sql = _LATE_DAYS.replace("{a}", "date_format(o_orderdate, 'yyyy-MM-dd')").replace("{b}", "date_format(o_orderdate, 'yyyy/MM/dd')")
    return issues(prof.profile_columns(view(spark, sf, sql)).where("name = 'day'"))


_MANY_CASES = "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'Key ' ELSE 'KEY ' END || CAST(o_orderkey % 250 AS STRING) AS label FROM {orders}"


@query(
    "r9_many_values_in_two_casings",
    f"""SELECT 'label' AS name, count(DISTINCT label) || ' spellings, ' || count(DISTINCT lower(label)) || ' without regard to casing' AS issue
        FROM ({_MANY_CASES}) HAVING count(DISTINCT lower(label)) < count(DISTINCT label)""",
)
def r9_many(spark, sf):
    return issues(prof.profile_columns(view(spark, sf, _MANY_CASES)))


ORDER_COLUMNS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "other", "o_orderpriority": "text",
}


@query(
    "r13_profile_json",
    f"""SELECT name, null_count, round(null_pct, 2) AS null_pct, unique_count, samples, issue_count, row_count, col_count, quality_score, duplicate_count
        FROM ({column_sql('SELECT * FROM orders', ORDER_COLUMNS)}), ({score_sql('SELECT * FROM orders', ORDER_COLUMNS)}),
             ({' UNION ALL '.join(f"SELECT '{c}' AS sampled, string_agg(v, '/' ORDER BY o_orderkey) AS samples FROM (SELECT o_orderkey, CAST({c} AS VARCHAR) AS v FROM orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 5)" for c in ORDER_COLUMNS)})
        WHERE sampled = name""",
)
def r13(spark, sf):
    report = spark.createDataFrame([(prof.profile_json(table(spark, sf, "orders"), "o_orderkey"),)], "report string")
    column = "struct<name string, nullCount long, nullPct double, uniqueCount long, sampleValues array<string>, issues array<string>>"
    shape = f"struct<rowCount long, colCount int, qualityScore int, duplicateCount long, columns array<{column}>>"
    read = report.select(F.from_json("report", shape).alias("r")).select("r.*", F.explode("r.columns").alias("c"))
    return read.select(
        "c.name", F.col("c.nullCount").alias("null_count"), F.col("c.nullPct").alias("null_pct"), F.col("c.uniqueCount").alias("unique_count"),
        F.array_join("c.sampleValues", "/").alias("samples"), F.size("c.issues").alias("issue_count"), F.col("rowCount").alias("row_count"),
        F.col("colCount").alias("col_count"), F.col("qualityScore").alias("quality_score"), F.col("duplicateCount").alias("duplicate_count"),
    )


@query(
    "r14_memory_estimate",
    "SELECT count(*) AS row_count, round(sum(8 + coalesce(strlen(url), 0) + coalesce(strlen(html), 0)) / 1048576.0::DOUBLE, 6) AS memory_mb FROM pages",
)
def r14(spark, sf):
    return prof.profile(table(spark, sf, "pages"), approximate=True).select("row_count", F.round("memory_mb", 6).alias("memory_mb"))


@query(
    "r15_profile_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, * FROM ({score_sql(f'SELECT * FROM {t}', columns)})"
        for t, columns in {
            "supplier": {"s_suppkey": "number", "s_name": "text", "s_nationkey": "number", "s_acctbal": "number"},
            "labels": {"doc_id": "number", "quality": "number", "toxic": "number"},
            "events": EVENT_COLUMNS,
        }.items()
    ),
)
def r15(spark, sf):
    return prof.profile_tables({t: table(spark, sf, t) for t in ("supplier", "labels", "events")})


# The exact part of a merged profile; estimates are only held to their error.
@query(
    "r15_merged_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value,
            round(avg({c}), 6)::DOUBLE AS mean_value, true AS close FROM ({_GAPPY})"""
        for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    ),
)
def r15_merged(spark, sf):
    lines = view(spark, sf, GAPPY_LINEITEM).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    parts = [column_states(lines.where(f"l_orderkey % 3 = {k}")) for k in range(3)]
    exact = prof.distinct_counts(lines, whole_rows=False)
    known = spark.createDataFrame([(c, exact[c]) for c in lines.columns], "name string, exact long")
    said = describe_states(merge_states(*parts)).join(known, "name")
    close = F.abs(F.col("unique_estimate") - F.col("exact")) <= 0.1 * F.col("exact")
    return said.select("name", "row_count", "null_count", "min_value", "max_value", F.round("mean_value", 6).alias("mean_value"), close.alias("close"))


# -- G: DDL ---------------------------------------------------------------------------------

ENGINE_TYPES = {
    "postgresql": {"BIGINT": "BIGINT", "INTEGER": "INTEGER", "DOUBLE": "DOUBLE PRECISION", "VARCHAR": "VARCHAR(255)", "TIMESTAMP": "TIMESTAMP"},
    "mysql": {"BIGINT": "BIGINT", "INTEGER": "INTEGER", "DOUBLE": "DOUBLE", "VARCHAR": "VARCHAR(255)", "TIMESTAMP": "TIMESTAMP"},
    "sqlite": {"BIGINT": "INTEGER", "INTEGER": "INTEGER", "DOUBLE": "REAL", "VARCHAR": "TEXT", "TIMESTAMP": "TEXT"},
}
LINE_TYPES = {
    "l_orderkey": "BIGINT", "l_linenumber": "INTEGER", "l_partkey": "BIGINT", "l_shipdate": "TIMESTAMP", "l_quantity": "DOUBLE",
    "l_suppkey": "BIGINT", "l_returnflag": "VARCHAR",
}


def ddl_sql(engine: str) -> str:
    parts = []
    for i, (c, t) in enumerate(LINE_TYPES.items()):
        hint = {
            "TIMESTAMP": "'time'",
            "VARCHAR": f"CASE WHEN count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) < 0.1 * count(*) THEN 'category' END",
        }.get(t, "NULL::VARCHAR")
        parts.append(
            f"""SELECT {i} AS ordinal, '{c}' AS column_name, '{ENGINE_TYPES[engine][t]}' AS sql_type, count(*) > count({c}) AS nullable,
                {hint} AS layout_hint FROM ({_GAPPY})"""
        )
    return " UNION ALL ".join(parts)


for _engine in ENGINE_TYPES:

    @query(f"g1_g2_ddl_{_engine}", ddl_sql(_engine))
    def g1(spark, sf, engine=_engine):
        return ddl.ddl_profile(view(spark, sf, GAPPY_LINEITEM), engine)


@query(
    "g1_ddl_long_text",
    """SELECT 1 AS ordinal, 'text' AS column_name, CASE WHEN max(length(text)) > 255 THEN 'TEXT' ELSE 'VARCHAR(255)' END AS sql_type,
              count(*) > count(text) AS nullable FROM documents""",
)
def g1_long(spark, sf):
    out = ddl.ddl_profile(table(spark, sf, "documents"))
    return out.where("column_name = 'text'").select("ordinal", "column_name", "sql_type", "nullable")


@query(
    "g1_create_table",
    f"""SELECT 'CREATE TABLE lines (' || chr(10) || string_agg('    "' || column_name || '" ' || sql_type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END,
               ',' || chr(10) ORDER BY ordinal) || chr(10) || ');' AS ddl FROM ({ddl_sql('postgresql')})""",
)
def g1_text(spark, sf):
    text = ddl.create_table(view(spark, sf, GAPPY_LINEITEM), "lines")
    return spark.createDataFrame([(text,)], "ddl string")


# -- S10: tables of a source ----------------------------------------------------------------

SPARK_TYPES = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


@query(
    "s10_describe_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{dt}' AS column_type, true AS nullable, (SELECT count(*) FROM {t}) AS row_count"
        for t, cs in SPARK_TYPES.items()
        for i, (c, dt) in enumerate(cs.items())
    ),
)
def s10(spark, sf):
    return tbl.describe_tables({t: table(spark, sf, t) for t in SPARK_TYPES})


@query(
    "s10_get_tables",
    " UNION ALL ".join(f"SELECT 's10_{t}' AS table_name, {len(cs)} AS column_count, (SELECT count(*) FROM {t}) AS row_count, true AS is_view" for t, cs in SPARK_TYPES.items()),
)
def s10_tables(spark, sf):
    for t in SPARK_TYPES:
        table(spark, sf, t).createOrReplaceTempView(f"s10_{t}")
    listed = tbl.get_tables(spark).where(F.col("table_name").isin([f"s10_{t}" for t in SPARK_TYPES]))
    return listed.groupBy("table_name", "row_count", "is_view").agg(F.count("*").cast("int").alias("column_count"))


@query(
    "s10_row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
)
def s10_counts(spark, sf):
    return tbl.describe_tables({t: table(spark, sf, t) for t in TABLES}).select("table_name", "row_count").distinct()
