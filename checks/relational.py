"""Filters, column picks, sorts, joins, aggregates, unions, and plain SQL."""

from pyspark.sql import functions as F

from burnish.functions.ordering import with_row_index
from burnish.functions.text import bucketize
from burnish.operators import columns as cols
from burnish.operators import relational as rel
from burnish.operators.overlap import overlap_summary
from burnish.sources.datasets import run_query
from checks.registry import DIRTY_CUSTOMER, query, table, view



@query(
    "flagship_filter_group_sort",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_quantity, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def flagship(spark, sf):
    kept = cols.filter_rows(table(spark, sf, "lineitem"), "l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").df
    out = kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_quantity"), F.count(F.lit(1)).alias("n")
    )
    return rel.sort_by(out, "n")


# -- P: columns and filters -----------------------------------------------------------------

@query("p1_drop_columns", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def p1(spark, sf):
    return cols.drop_columns(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "no_such_column"]).df


@query("p2_rename_column", "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p2(spark, sf):
    return cols.rename_column(table(spark, sf, "customer"), "c_name", "customer_name").df


@query(
    "p3_filter_rows",
    "SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-01-01'",
)
def p3(spark, sf):
    condition = "l_quantity > 30 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'"
    return cols.filter_rows(table(spark, sf, "lineitem"), condition).df


@query("p3_filter_rows_removed", "SELECT count(*) AS rows_affected FROM orders WHERE NOT (o_totalprice < 200000)")
def p3_metrics(spark, sf):
    return cols.filter_rows(table(spark, sf, "orders"), "o_totalprice < 200000").metrics


@query("p4_select_columns", "SELECT p_partkey, p_name FROM part")
def p4(spark, sf):
    return cols.select_columns(table(spark, sf, "part"), ["p_partkey", "p_name"])


TEXT_TESTS = {
    "contains": (" RED ", "contains(lower(coalesce(p_name, '')), 'red')"),
    "not_contains": ("red", "NOT contains(lower(coalesce(p_name, '')), 'red')"),
    "equals": ("Red Widget", "lower(coalesce(p_name, '')) = 'red widget'"),
    "not_equals": ("red widget", "lower(coalesce(p_name, '')) <> 'red widget'"),
    "starts_with": ("SMALL", "starts_with(lower(coalesce(p_name, '')), 'small')"),
    "ends_with": ("Ring", "ends_with(lower(coalesce(p_name, '')), 'ring')"),
}
for _op, (_value, _sql) in TEXT_TESTS.items():

    @query(f"p5_grid_{_op}", f"SELECT p_partkey, p_name FROM part WHERE {_sql}")
    def p5(spark, sf, op=_op, value=_value):
        return cols.grid_view(table(spark, sf, "part"), [("p_name", op, value)]).select("p_partkey", "p_name")


for _op, _sign in {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():

    @query(f"p6_grid_{_op}", f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal {_sign} 2500.5")
    def p6(spark, sf, op=_op):
        return cols.grid_view(table(spark, sf, "customer"), [("c_acctbal", op, "2500.5")]).select("c_custkey", "c_acctbal")


for _op, _test in {"is_empty": "IS NULL", "not_empty": "IS NOT NULL"}.items():

    @query(f"p7_grid_{_op}", f"SELECT c_custkey, c_mktsegment FROM ({DIRTY_CUSTOMER}) WHERE c_mktsegment {_test}")
    def p7(spark, sf, op=_op):
        return cols.grid_view(view(spark, sf, DIRTY_CUSTOMER), [("c_mktsegment", op)]).select("c_custkey", "c_mktsegment")


@query(
    "p8_grid_filters_and_sort",
    """SELECT * FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_totalprice >= 100000
       AND lower(o_orderstatus) <> 'f'""",
)
def p8(spark, sf):
    filters = [("o_orderpriority", "contains", "urgent"), ("o_totalprice", "gte", "100000"), ("o_orderstatus", "not_equals", "F")]
    return cols.grid_view(table(spark, sf, "orders"), filters, ("o_totalprice", "desc"))


# -- T: order and top-k ---------------------------------------------------------------------

@query("t1_sort_by_desc", "SELECT * FROM orders ORDER BY o_totalprice DESC")
def t1_desc(spark, sf):
    return rel.sort_by(table(spark, sf, "orders"), "o_totalprice")


@query(
    "t1_sort_by_asc_nulls_last",
    f"SELECT c_custkey, c_acctbal FROM ({DIRTY_CUSTOMER})",
)
def t1_asc(spark, sf):
    return rel.sort_by(view(spark, sf, DIRTY_CUSTOMER), "c_acctbal", "asc").select("c_custkey", "c_acctbal")


# Cells of a text column, a third of which are no numbers, some empty.
_MIXED = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 7 = 0 THEN NULL
            ELSE CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS STRING) END AS cell FROM {customer}"""


@query(
    "t2_grid_sort_rank",
    f"""SELECT c_custkey, cell, row_number() OVER (ORDER BY TRY_CAST(cell AS DOUBLE) NULLS LAST, coalesce(cell, ''), c_custkey) - 1 AS place
        FROM ({_MIXED})""",
)
def t2(spark, sf):
    return with_row_index(view(spark, sf, _MIXED), [*cols.grid_sort("cell"), F.col("c_custkey")], "place")


@query(
    "t2_grid_sort_rank_descending",
    f"""SELECT c_custkey, cell, row_number() OVER (ORDER BY TRY_CAST(cell AS DOUBLE) DESC NULLS LAST, coalesce(cell, '') DESC, c_custkey) - 1 AS place
        FROM ({_MIXED})""",
)
def t2_down(spark, sf):
    return with_row_index(view(spark, sf, _MIXED), [*cols.grid_sort("cell", "desc"), F.col("c_custkey")], "place")


@query("t3_slice", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 150 OFFSET 100")
def t3(spark, sf):
    return rel.slice_rows(table(spark, sf, "orders"), 100, 250, "o_orderkey")


@query(
    "t3_slice_deep",
    "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 3000 OFFSET 20000",
)
def t3_deep(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return rel.slice_rows(table(spark, sf, "lineitem"), 20_000, 23_000, key)


@query("t4_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST LIMIT 25")
def t4(spark, sf):
    return rel.sort_by(table(spark, sf, "orders"), "o_totalprice", "desc", 25).select("o_orderkey", "o_totalprice")


def placed(df):
    """The rows with their places in the order in which they come."""
    numbered = df.withColumn("came", F.monotonically_increasing_id())
    return with_row_index(numbered, [F.col("came")], "place").drop("came")


@query("t1_sort_by_places", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name DESC) - 1 AS place FROM customer")
def t1_places(spark, sf):
    return placed(rel.sort_by(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name"))


@query(
    "p8_grid_sort_places",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders WHERE contains(lower(o_orderpriority), 'urgent')""",
)
def p8_places(spark, sf):
    rows = cols.grid_view(table(spark, sf, "orders"), [("o_orderpriority", "contains", "urgent")], ("o_orderkey", "desc"))
    return placed(rows.select("o_orderkey"))


@query("t3_slice_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 150 OFFSET 100)")
def t3_places(spark, sf):
    return placed(rel.slice_rows(table(spark, sf, "orders"), 100, 250, "o_orderkey").select("o_orderkey"))


@query("k6_preview_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)")
def k6_places(spark, sf):
    return placed(rel.preview(table(spark, sf, "orders"), 100, "o_orderkey").select("o_orderkey"))


_TOP = ["l_returnflag", "l_linenumber", "l_discount"]


@query(
    "t5_top_values",
    """WITH m AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM lineitem" for c in _TOP)
    + """), n AS (SELECT "column", value, count(*) AS "count" FROM m GROUP BY ALL)
       SELECT "column", value, "count", rank FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS INTEGER) AS rank FROM n)
       WHERE rank <= 3""",
)
def t5(spark, sf):
    return rel.top_values(table(spark, sf, "lineitem"), _TOP, 3)


# -- J: joins -------------------------------------------------------------------------------

_RICH = "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS amount FROM {customer} WHERE c_acctbal > 1000"
_PAID = "SELECT o_orderkey, o_custkey AS custkey, o_totalprice AS amount FROM {orders} WHERE o_totalprice > 200000"
for _how, _word in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():

    @query(
        f"j1_join_{_how}",
        f"""SELECT l.custkey, l.name, l.amount, r.o_orderkey, r.custkey AS custkey_right, r.amount AS amount_right
            FROM ({_RICH}) l {_word} ({_PAID}) r ON l.custkey = r.custkey""",
    )
    def j1(spark, sf, how=_how):
        return rel.join_tables(view(spark, sf, _RICH), view(spark, sf, _PAID), "custkey", how)


for _how, _word in {"semi": "SEMI JOIN", "anti": "ANTI JOIN"}.items():

    @query(f"j1_join_{_how}", f"SELECT l.* FROM ({_RICH}) l {_word} ({_PAID}) r ON l.custkey = r.custkey")
    def j1_filter(spark, sf, how=_how):
        return rel.join_tables(view(spark, sf, _RICH), view(spark, sf, _PAID), "custkey", how)


@query(
    "j1_join_two_keys",
    """SELECT l.l_orderkey AS orderkey, l.l_suppkey AS suppkey, l.l_quantity, r.l_orderkey AS orderkey_right,
              r.l_suppkey AS suppkey_right, r.n
       FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) r
       ON l.l_orderkey = r.l_orderkey AND l.l_suppkey = r.l_suppkey""",
)
def j1_two(spark, sf):
    lines = view(spark, sf, "SELECT l_orderkey AS orderkey, l_suppkey AS suppkey, l_quantity FROM {lineitem}")
    repeated = lines.groupBy("orderkey", "suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rel.join_tables(lines, repeated, ["orderkey", "suppkey"])


# -- A: aggregates --------------------------------------------------------------------------

@query("a1_group_count", "SELECT o_orderpriority, count(*) AS count_all FROM orders GROUP BY 1")
def a1_count(spark, sf):
    return rel.aggregate(table(spark, sf, "orders"), "o_orderpriority")


for _fn in ("sum", "avg", "min", "max"):

    @query(
        f"a1_group_{_fn}",
        f"""SELECT l_returnflag, l_linestatus, round({_fn}(l_extendedprice), 2) AS {_fn}_l_extendedprice
            FROM lineitem GROUP BY 1, 2""",
    )
    def a1(spark, sf, fn=_fn):
        name = f"{fn}_l_extendedprice"
        out = rel.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], fn, "l_extendedprice")
        return out.withColumn(name, F.round(name, 2))


@query(
    "a1_group_count_distinct",
    "SELECT l_shipdate, count(DISTINCT l_partkey) AS count_distinct_l_partkey FROM lineitem GROUP BY 1",
)
def a1_distinct(spark, sf):
    return rel.aggregate(table(spark, sf, "lineitem"), "l_shipdate", "count_distinct", "l_partkey")


@query(
    "a2_having",
    "SELECT o_custkey, count(*) AS count_all FROM orders GROUP BY 1 HAVING count(*) >= 15",
)
def a2(spark, sf):
    return rel.aggregate(table(spark, sf, "orders"), "o_custkey", having="count_all >= 15")


@query(
    "a3_carried_columns",
    """SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS o_orderpriority,
              first(o_orderdate ORDER BY o_orderkey) AS o_orderdate, max(o_totalprice) AS max_o_totalprice
       FROM orders GROUP BY 1""",
)
def a3(spark, sf):
    return rel.aggregate(
        table(spark, sf, "orders"), "o_custkey", "max", "o_totalprice", columns=["o_orderpriority", "o_orderdate"], order_by="o_orderkey"
    )


@query(
    "a4_bucketize",
    "SELECT CAST(floor(p_size / 10) * 10 AS INTEGER) AS decade, count(*) AS count_all FROM part GROUP BY 1",
)
def a4(spark, sf):
    return rel.aggregate(table(spark, sf, "part").withColumn("decade", bucketize(F.col("p_size"), 10)), "decade")


@query(
    "u1_union_tagged",
    """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""",
)
def u1(spark, sf):
    customers = view(spark, sf, "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM {customer}")
    suppliers = view(spark, sf, "SELECT s_suppkey AS key, s_acctbal AS balance FROM {supplier}")
    return rel.union_tagged({"customer": customers, "supplier": suppliers})


# -- Q: SQL pass-through --------------------------------------------------------------------

def sql_query(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query that is the same SQL on both sides, or its nearest dialect form."""

    @query(name, duck_sql or spark_sql)
    def run(spark, sf):
        return view(spark, sf, spark_sql)


@query("q1_run_query", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def q1(spark, sf):
    return run_query(table(spark, sf, "customer"), "SELECT c_custkey, c_name FROM debtors WHERE c_acctbal < 0", "debtors")


sql_query("q2_group_by", "SELECT event_type, count(*) AS n, max(value) AS top FROM {events} GROUP BY event_type")
sql_query(
    "q3_join_sum",
    """SELECT n_name, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey
       JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY total DESC""",
)
sql_query(
    "q4_union_decades",
    """SELECT 'part' AS source, CAST(floor(p_size / 10) * 10 AS INTEGER) AS decade, count(*) AS n FROM {part} GROUP BY ALL
       UNION ALL SELECT 'nation', CAST(floor(c_nationkey / 10) * 10 AS INTEGER), count(*) FROM {customer} GROUP BY ALL""",
)
sql_query(
    "q5_multi_join",
    """SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
       JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
       GROUP BY r_name, p_brand""",
)
sql_query(
    "q6_semi_join",
    "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
sql_query(
    "q6_anti_join",
    "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
sql_query(
    "q6_inequality_join",
    """SELECT a.o_orderkey, b.l_linenumber, b.l_shipdate FROM {orders} a JOIN {lineitem} b
       ON a.o_orderkey = b.l_orderkey AND b.l_shipdate < a.o_orderdate""",
)
_OPEN = """SELECT o_orderkey AS {k}, o_orderpriority AS {p}, datediff(o_orderdate, DATE '1995-01-01') AS {s},
  datediff(o_orderdate, DATE '1995-01-01') + CASE WHEN o_orderkey % 100 = 0 THEN 60 ELSE o_orderkey % 4 END AS {e} FROM {orders}"""
_OPEN_A = _OPEN.replace("{k}", "a_key").replace("{p}", "a_priority").replace("{s}", "a_start").replace("{e}", "a_end")
_OPEN_B = _OPEN.replace("{k}", "b_key").replace("{p}", "b_priority").replace("{s}", "b_start").replace("{e}", "b_end")


# Orders that are open at the same time as an urgent one: no equality to join on.
@query(
    "q6_overlap_join",
    f"""SELECT a_key, count(*) AS n, max(b_key) AS last_key FROM ({_OPEN_A}) JOIN ({_OPEN_B}) ON a_start <= b_end AND b_start <= a_end
        WHERE b_priority = '1-URGENT' AND a_key <> b_key GROUP BY a_key""".replace("datediff(o_orderdate, DATE '1995-01-01')", "date_diff('day', DATE '1995-01-01', o_orderdate)"),
)
def q6_overlap(spark, sf):
    urgent = view(spark, sf, _OPEN_B).where("b_priority = '1-URGENT'")
    return overlap_summary(view(spark, sf, _OPEN_A), urgent, ("a_start", "a_end"), ("b_start", "b_end"), "a_key", "b_key")


sql_query(
    "q7_as_of_join",
    """SELECT event_id, user_id, last_error FROM (
         SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END) IGNORE NULLS OVER (
                  PARTITION BY user_id ORDER BY ts, event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error
         FROM {events} WHERE event_type IN ('error', 'purchase'))
       WHERE event_type = 'purchase' AND last_error IS NOT NULL""",
    """SELECT c.event_id, c.user_id, e.event_id AS last_error FROM (SELECT * FROM events WHERE event_type = 'purchase') c
       ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') e ON c.user_id = e.user_id AND c.ts >= e.ts""",
)
sql_query(
    "q8_grouping_sets",
    """SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n,
              count(DISTINCT l_suppkey) AS suppliers
       FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
)
sql_query(
    "q8_rollup",
    """SELECT coalesce(o_orderstatus, '-') AS status, coalesce(o_orderpriority, '-') AS priority, count(*) AS n
       FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
sql_query(
    "q8_cube",
    """SELECT coalesce(p_brand, '-') AS brand, coalesce(p_type, '-') AS type, max(p_retailprice) AS top
       FROM {part} GROUP BY CUBE (p_brand, p_type)""",
)
sql_query(
    "q9_window_ranking",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter
       FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
sql_query(
    "q9_window_frames",
    """SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after,
              max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_top,
              count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
       FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
_A, _B = "SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_quantity > 25", "SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_discount > 0.05"
for _name, _op in {
    "union": "UNION",
    "union_all": "UNION ALL",
    "intersect": "INTERSECT",
    "intersect_all": "INTERSECT ALL",
    "except": "EXCEPT",
    "except_all": "EXCEPT ALL",
}.items():
    sql_query(f"q10_{_name}", f"{_A} {_op} {_B}")
sql_query("q10_except_keys", "SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000")
sql_query(
    "q11_string_scalars",
    """SELECT doc_id, length(text) AS n, upper(lang) AS lang3, substr(text, 1, 10) AS head, replace(lang, 'e', 'E') AS lang2,
              strpos(text, 'the') AS at, concat(source, ':', lang) AS tag, reverse(lang) AS back FROM {documents}""".replace(
        "strpos(text, 'the')", "instr(text, 'the')"
    ),
)
sql_query(
    "q11_date_scalars",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
              datediff(DATE '2003-01-01', CAST(o_orderdate AS DATE)) AS days FROM {orders}""",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
              date_diff('day', CAST(o_orderdate AS DATE), DATE '2003-01-01') AS days FROM orders""",
)
sql_query(
    "q11_json_scalars",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
sql_query(
    "q11_math_scalars",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05) AS gap, floor(l_extendedprice) AS f, ceil(l_tax * 100) AS c,
              round(sqrt(l_quantity), 6) AS s FROM {lineitem}""",
)
sql_query(
    "q11_array_scalars",
    """SELECT vec_id, size(embedding) AS n, array_max(embedding) AS top, array_position(transform(embedding, x -> x > 0), true) AS first_up
       FROM {embeddings}""",
    """SELECT vec_id, len(embedding) AS n, list_max(embedding) AS top,
              list_position(list_transform(embedding, lambda x: x > 0), true) AS first_up FROM embeddings""",
)
sql_query(
    "q12_subqueries_and_ctes",
    """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
       SELECT c_mktsegment, count(*) AS n FROM {customer} JOIN spend ON c_custkey = o_custkey
       WHERE total > (SELECT avg(total) FROM spend)
         AND c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3)
       GROUP BY c_mktsegment""",
)
sql_query(
    "q12_correlated_subquery",
    """SELECT o_orderkey, o_totalprice FROM {orders} a
       WHERE o_totalprice = (SELECT max(b.o_totalprice) FROM {orders} b WHERE b.o_custkey = a.o_custkey)""",
)
