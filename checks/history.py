"""Versioned tables, diffs, recorded actions and automatic cleaning."""

import json

from pyspark.sql import functions as F

from burnish.functions.scratch import scratch_path
from burnish.plans import actions as act
from burnish.plans import versions as ver
from burnish.plans.versions import VersionStore
from burnish.sources.datasets import Datasets
from checks.duplicates import merge_walk
from checks.profiling import CUSTOMER_COLUMNS, score_sql
from checks.registry import DIRTY_CUSTOMER, GAPPY_LINEITEM, plain, query, table, view

_DIRTY = plain(DIRTY_CUSTOMER)

CLEANING = [
    {"type": "fix_formats", "params": {"format_type": "auto"}},
    {"type": "standardize", "params": {"method": "lowercase"}, "target": "column:c_mktsegment"},
    {"type": "fill_nulls", "params": {"strategy": "zero"}, "target": "column:c_acctbal"},
    {"type": "filter_rows", "params": {"condition": "c_nationkey IS NOT NULL"}},
    {"type": "rename_column", "params": {"from": "c_acctbal", "to": "balance"}},
    {"type": "drop_columns", "params": {"columns": ["c_email", "nothing"]}},
]
_STRIPPED = r"regexp_replace(c_name, '^\s+|\s+$', '', 'g')"
CLEANED_SQL = f"""SELECT c_custkey, {_STRIPPED} AS c_name, c_nationkey, coalesce(c_acctbal, 0) AS balance,
                         lower(c_mktsegment) AS c_mktsegment FROM ({_DIRTY}) WHERE c_nationkey IS NOT NULL"""


def filled_store(spark, sf, quality_score=0) -> VersionStore:
    """The dirty customers, cleaned in recorded steps."""
    store = VersionStore(spark, scratch_path(spark, "store"), order_by="c_custkey")
    store.create_initial(view(spark, sf, DIRTY_CUSTOMER), quality_score)
    act.run_and_commit(store, CLEANING[1:4:2], order_by="c_custkey")
    return store


# -- V: versions ----------------------------------------------------------------------------

_TIMELINE = f"""
  SELECT 0 AS position, 'v1 Original' AS label, 'load' AS operation, (SELECT count(*) FROM customer) AS rows_affected,
         (SELECT count(*) FROM customer) AS row_count, 6 AS col_count, NULL AS parent_position
  UNION ALL SELECT 1, 'v2 Standardize', 'standardize', (SELECT count_if(c_mktsegment <> lower(c_mktsegment)) FROM ({_DIRTY})),
         (SELECT count(*) FROM customer), 6, 0
  UNION ALL SELECT 2, 'v3 Filter Rows', 'filter_rows', (SELECT count_if(c_nationkey IS NULL) FROM ({_DIRTY})),
         (SELECT count(c_nationkey) FROM ({_DIRTY})), 6, 1"""


@query("v1_v6_timeline", _TIMELINE)
def v1(spark, sf):
    line = filled_store(spark, sf).get_timeline()
    parents = line.select(F.col("id").alias("parent_id"), F.col("position").alias("parent_position"))
    return line.join(parents, "parent_id", "left").select(
        "position", "label", "operation", "rows_affected", "row_count", "col_count", "parent_position"
    )


_SNAPSHOTS = [
    _DIRTY,
    f"SELECT * REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM ({_DIRTY})",
    f"SELECT * REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM ({_DIRTY}) WHERE c_nationkey IS NOT NULL",
]


@query(
    "v1_quality_scores",
    " UNION ALL ".join(f"SELECT {i} AS position, quality_score FROM ({score_sql(s, CUSTOMER_COLUMNS)})" for i, s in enumerate(_SNAPSHOTS)),
)
def v1_scores(spark, sf):
    return filled_store(spark, sf, quality_score=None).get_timeline().select("position", "quality_score")


@query("v2_checkout", _DIRTY)
def v2(spark, sf):
    store = filled_store(spark, sf)
    return store.checkout(store.versions[0].id)


@query("v3_undo", f"SELECT * REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM ({_DIRTY})")
def v3_undo(spark, sf):
    return filled_store(spark, sf).undo()


@query("v3_redo", f"SELECT * REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM ({_DIRTY}) WHERE c_nationkey IS NOT NULL")
def v3_redo(spark, sf):
    store = filled_store(spark, sf)
    store.undo()
    store.undo()
    store.redo()
    return store.redo()


_SHORT = "SELECT o_orderkey, o_totalprice, upper(o_orderpriority) AS priority FROM {orders} WHERE o_orderstatus <> 'P'"


@query(
    "v4_v8_table_summary",
    """SELECT n AS rows_a, m AS rows_b, m - n AS row_diff, CAST(greatest(m - n, 0) AS BIGINT) AS rows_added,
              CAST(greatest(n - m, 0) AS BIGINT) AS rows_removed, 6 AS cols_a, 3 AS cols_b, 'priority' AS columns_added,
              'o_custkey/o_orderstatus/o_orderdate/o_orderpriority' AS columns_removed, 'o_orderkey/o_totalprice' AS columns_common
       FROM (SELECT count(*) AS n, count_if(o_orderstatus <> 'P') AS m FROM orders)""",
)
def v4(spark, sf):
    out = ver.table_summary(table(spark, sf, "orders"), view(spark, sf, _SHORT))
    lists = ("columns_added", "columns_removed", "columns_common")
    return out.withColumns({c: F.array_join(c, "/") for c in lists})


_REVISED = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey, lower(o_orderstatus) AS o_orderstatus,
  CASE WHEN o_totalprice > 300000 THEN round(o_totalprice, 0) ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM {orders}"""


def diff_sql(pairs: str, columns: dict[str, tuple[str, str]]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count_if({a} <> {b}) AS cells_changed, count_if({a} IS DISTINCT FROM {b}) AS cells_changed_nulls,
            count(*) AS rows_compared FROM ({pairs})"""
        for c, (a, b) in columns.items()
    )
    return f"SELECT *, round(100.0 * cells_changed / rows_compared, 2) AS pct_changed FROM ({parts})"


_ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "v5_diff_by_key",
    diff_sql(
        "SELECT " + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _ORDER_COLUMNS)
        + f" FROM orders a JOIN ({plain(_REVISED)}) b USING (o_orderkey)",
        {c: (f"a_{c}", f"b_{c}") for c in _ORDER_COLUMNS},
    ),
)
def v5_key(spark, sf):
    return ver.table_diff(table(spark, sf, "orders"), view(spark, sf, _REVISED), ["o_orderkey"])


@query(
    "v5_diff_by_position",
    diff_sql(
        """SELECT a.l_quantity AS a_q, b.l_quantity AS b_q, a.l_returnflag AS a_f, b.l_returnflag AS b_f FROM
           (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) a JOIN
           (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem
            WHERE l_orderkey > 100) b USING (n)""",
        {"l_quantity": ("a_q", "b_q"), "l_returnflag": ("a_f", "b_f")},
    ),
)
def v5_position(spark, sf):
    df = table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ver.diff_by_position(df, df.where("l_orderkey > 100"), key, ["l_quantity", "l_returnflag"])


@query(
    "v5_diff_of_versions",
    diff_sql(f"SELECT c_mktsegment AS a, lower(c_mktsegment) AS b FROM ({_DIRTY})", {"c_mktsegment": ("a", "b")}),
)
def v5_versions(spark, sf):
    store = filled_store(spark, sf)
    first, second = [v.id for v in store.versions[:2]]
    return store.diff(first, second).where("column_name = 'c_mktsegment'")


@query(
    "v7_delete_version",
    """SELECT 0 AS position, 'v1 Original' AS label, NULL AS parent_position UNION ALL SELECT 1, 'v2 Filter Rows', 0""",
)
def v7(spark, sf):
    store = filled_store(spark, sf)
    store.delete_version(store.versions[1].id)
    line = store.get_timeline()
    parents = line.select(F.col("id").alias("parent_id"), F.col("position").alias("parent_position"))
    return line.join(parents, "parent_id", "left").select("position", "label", "parent_position")


_BEFORE = "SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_quantity > 10"
_AFTER = "SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_quantity < 30"


@query(
    "v8_row_changes",
    f"""WITH a AS ({_BEFORE}), b AS ({_AFTER})
        SELECT *, 'removed' AS change, count(*) AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
        UNION ALL SELECT *, 'added', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
)
def v8(spark, sf):
    return ver.row_changes(view(spark, sf, _BEFORE), view(spark, sf, _AFTER))


# -- X: actions -----------------------------------------------------------------------------

_LOWER_NAME = r"regexp_replace(c_name, '^\s+|\s+$', '', 'g')"
_LOWER_MAIL = r"lower(regexp_replace(c_email, '^\s+|\s+$', '', 'g'))"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM fixed WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "x1_auto_clean",
    merge_walk(f"SELECT * REPLACE ({_LOWER_NAME} AS c_name, {_LOWER_MAIL} AS c_email) FROM ({_DIRTY})", "c_mktsegment")
    + f""", fixed AS (SELECT src.* REPLACE (canonical AS c_mktsegment) FROM src LEFT JOIN merged ON c_mktsegment = value)
        SELECT c_custkey, c_name, coalesce(c_nationkey, {_mode('c_nationkey')}) AS c_nationkey,
               coalesce(c_acctbal, {_mode('c_acctbal')}) AS c_acctbal, coalesce(c_mktsegment, {_mode('c_mktsegment')}) AS c_mktsegment, c_email
        FROM fixed""",
)
def x1(spark, sf):
    return act.auto_clean(view(spark, sf, DIRTY_CUSTOMER), order_by="c_custkey")[0]


@query("x2_apply_actions", CLEANED_SQL)
def x2(spark, sf):
    return act.apply_actions(view(spark, sf, DIRTY_CUSTOMER), CLEANING, order_by="c_custkey")


@query(
    "x2_query_actions",
    """SELECT * FROM (SELECT l_returnflag, count(*) AS count_all, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity <= 30 GROUP BY l_returnflag, n_name HAVING count(*) > 10)
       ORDER BY n_name, l_returnflag LIMIT 20 OFFSET 5""",
)
def x2_queries(spark, sf):
    datasets = Datasets(spark)
    datasets.register("nation-of supplier.csv", view(spark, sf, "SELECT s_suppkey AS l_suppkey, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"))
    steps = [
        {"type": "query", "params": {"sql": "SELECT * FROM data WHERE l_quantity <= 30"}},
        {"type": "join", "params": {"right": "nation_of_supplier", "on": "l_suppkey", "how": "INNER"}},
        {"type": "group_by", "params": {"by": ["l_returnflag", "n_name"], "function": "count", "having": "count_all > 10"}},
        {"type": "slice", "params": {"start": 5, "stop": 25}},
    ]
    return act.apply_actions(table(spark, sf, "lineitem"), steps, ["n_name", "l_returnflag"], datasets)


@query(
    "x2_more_actions",
    f"""WITH g AS (SELECT DISTINCT l_linenumber, l_quantity, l_returnflag FROM ({plain(GAPPY_LINEITEM)})),
             f AS (SELECT l_linenumber, coalesce(l_quantity, median(l_quantity) OVER ()) AS l_quantity, l_returnflag FROM g)
        SELECT l_linenumber, l_quantity, l_returnflag FROM f, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM f)
        WHERE abs((l_quantity - m) / s) <= 1.2""",
)
def x2_more(spark, sf):
    steps = [
        {"type": "deduplicate"},
        {"type": "fill_nulls", "params": {"strategy": "median"}, "target": "column:l_quantity"},
        {"type": "remove_outliers", "params": {"method": "zscore", "threshold": 1.2, "column": "l_quantity"}},
    ]
    return act.apply_actions(view(spark, sf, GAPPY_LINEITEM).select("l_linenumber", "l_quantity", "l_returnflag"), steps)


@query("x3_actions_from_json", CLEANED_SQL)
def x3(spark, sf):
    text = json.dumps({"actions": [{"params": {"no": "type"}}, *CLEANING], "explanation": "tidy up"})
    return act.apply_actions(view(spark, sf, DIRTY_CUSTOMER), text, order_by="c_custkey")


@query("x4_replay", f"SELECT * REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM ({_DIRTY}) WHERE c_nationkey IS NOT NULL")
def x4(spark, sf):
    return act.replay(view(spark, sf, DIRTY_CUSTOMER), filled_store(spark, sf), order_by="c_custkey")


@query(
    "x5_query_result_as_dataset",
    f"SELECT c_mktsegment, max(c_acctbal) AS top FROM ({_DIRTY}) WHERE c_nationkey IS NOT NULL GROUP BY 1",
)
def x5(spark, sf):
    store, datasets = VersionStore(spark, scratch_path(spark, "store"), order_by="c_custkey"), Datasets(spark)
    store.create_initial(view(spark, sf, DIRTY_CUSTOMER))
    step = {"type": "query", "params": {"sql": "SELECT * FROM data WHERE c_nationkey IS NOT NULL", "description": "with nation"}}
    act.run_and_commit(store, [step], datasets=datasets)
    return spark.sql("SELECT c_mktsegment, max(c_acctbal) AS top FROM `with_nation.result` GROUP BY 1")
