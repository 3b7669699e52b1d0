"""Files and tables: written, read back, compared with the original."""

from pyspark.sql import functions as F

from burnish.functions.scratch import scratch_path
from burnish.operators.relational import preview
from burnish.sources import tables as tbl
from burnish.sources.datasets import Datasets
from burnish.sources.files import load
from burnish.sources.writers import export, insert_statements
from checks.registry import query, table, view

query("s1_s6_load_parquet", "SELECT * FROM orders")(lambda spark, sf: load(spark, f"{sf}/orders.parquet"))


def round_trip(spark, df, fmt: str, ext: str | None = None):
    """Export to a new folder and load it again."""
    path = scratch_path(spark, "export") + f".{ext or fmt}"
    export(df, path, fmt)
    return load(spark, path)


@query("k1_s2_csv", "SELECT * FROM orders")
def csv(spark, sf):
    back = round_trip(spark, table(spark, sf, "orders"), "csv")
    return back.withColumns({"o_orderkey": F.col("o_orderkey").cast("long"), "o_custkey": F.col("o_custkey").cast("long")})


@query("k1_s2_csv_texts", "SELECT doc_id, text, lang FROM documents")
def csv_texts(spark, sf):
    path = scratch_path(spark, "export") + ".csv"
    export(table(spark, sf, "documents").select("doc_id", "text", "lang"), path, "csv")
    return load(spark, path, schema="doc_id long, text string, lang string")


@query("k1_s3_tsv", "SELECT * FROM customer")
def tsv(spark, sf):
    back = round_trip(spark, table(spark, sf, "customer"), "tsv")
    return back.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("k2_s6_parquet", "SELECT * FROM lineitem")
def parquet(spark, sf):
    return round_trip(spark, table(spark, sf, "lineitem"), "parquet")


@query("k3_s5_json_lines", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_lines(spark, sf):
    return round_trip(spark, table(spark, sf, "documents"), "json", "jsonl")


@query("s4_json_documents", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def json_documents(spark, sf):
    # One array of at most 500 parts per file.
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    arrays = part.groupBy(F.floor(F.col("p_partkey") / 500).alias("b")).agg(
        F.to_json(F.collect_list(F.struct(*part.columns))).alias("value")
    )
    path = scratch_path(spark, "export") + ".json"
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = load(spark, path)
    return back.withColumn("p_size", F.col("p_size").cast("int"))


@query(
    "k4_sql_script",
    """SELECT 'INSERT INTO customers ("c_custkey", "c_name", "c_mktsegment", "c_nationkey") VALUES (' || c_custkey || ', '''
       || replace(c_name, '#', '''''') || ''', ' || coalesce('''' || nullif(c_mktsegment, 'BUILDING') || '''', 'NULL') || ', '
       || c_nationkey || ');' AS statement FROM customer""",
)
def k4(spark, sf):
    sql = """SELECT c_custkey, replace(c_name, '#', "'") AS c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_nationkey FROM {customer}"""
    return insert_statements(view(spark, sf, sql), "customers")


@query(
    "k4_sql_script_dates",
    """SELECT 'INSERT INTO orders ("o_orderkey", "o_orderdate") VALUES (' || o_orderkey || ', ''' || o_orderdate || ''');' AS statement
       FROM orders""",
)
def k4_dates(spark, sf):
    path = scratch_path(spark, "export")
    export(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), path, "sql", "orders")
    return spark.read.text(f"{path}/insert").withColumnRenamed("value", "statement")


def in_catalog(spark, sf, name: str, df=None) -> str:
    """A catalog table with its files in the scratch folder."""
    path = scratch_path(spark, "table")
    known = f"burnish_{name}_{path[-8:]}"
    tbl.write_table(table(spark, sf, name) if df is None else df, known, path=path)
    return known


@query("k5_write_table_append", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
def k5(spark, sf):
    path = scratch_path(spark, "table")
    name, df = f"burnish_supplier_{path[-8:]}", table(spark, sf, "supplier")
    tbl.write_table(df, name, if_exists="replace", path=path)
    tbl.write_table(df, name, if_exists="append", path=path)
    return tbl.read_table(spark, name)


@query("k5_write_table_replace", "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def k5_replace(spark, sf):
    path = scratch_path(spark, "table")
    name = f"burnish_part_{path[-8:]}"
    tbl.write_table(table(spark, sf, "part"), name, path=path)
    tbl.write_table(view(spark, sf, "SELECT p_partkey, p_name FROM {part} WHERE p_size > 25"), name, if_exists="replace", path=path)
    return tbl.read_table(spark, name)


@query("k6_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def k6(spark, sf):
    return preview(table(spark, sf, "orders"), 100, "o_orderkey")


@query("s7_read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def s7(spark, sf):
    name = in_catalog(spark, sf, "orders")
    return tbl.read_table(spark, name, columns=["o_orderkey", "o_totalprice"], where="o_orderstatus = 'F' AND o_totalprice > 1000")


@query("s8_read_query", "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1")
def s8(spark, sf):
    name = in_catalog(spark, sf, "customer")
    return tbl.read_query(spark, f"SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM {name} GROUP BY 1")


@query(
    "s9_read_tables",
    "SELECT 'nation' AS name, n_name AS label FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier",
)
def s9(spark, sf):
    names = {t: in_catalog(spark, sf, t) for t in ("nation", "supplier")}
    found = tbl.read_tables(spark, list(names.values()))
    nation = found[names["nation"]].select(F.lit("nation").alias("name"), F.col("n_name").alias("label"))
    return nation.unionAll(found[names["supplier"]].select(F.lit("supplier"), "s_name"))


@query(
    "s11_datasets",
    """SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1
       UNION ALL SELECT 'again', count(*) FROM orders""",
)
def s11(spark, sf):
    datasets = Datasets(spark)
    datasets.register("my orders-1.csv", table(spark, sf, "orders"))
    datasets.register("customer.parquet", table(spark, sf, "customer"), activate=False)
    again = datasets.register("my orders-1.csv", table(spark, sf, "orders"), activate=False)
    joined = spark.sql(
        """SELECT o_orderpriority, count(*) AS n FROM my_orders_1 JOIN `customer.parquet` ON o_custkey = c_custkey
           WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT 'again', count(*) FROM `{0}`""".format(again)
    )
    datasets.remove("customer.parquet")
    return joined
