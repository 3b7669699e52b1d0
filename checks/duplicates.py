"""Exact, fuzzy and semantic duplicates, and merged spellings."""

from pyspark.sql import functions as F

from burnish.functions.similarity import text_similarity
from burnish.operators import dedup
from checks.registry import DIRTY_CUSTOMER, plain, query, table, view

# -- exact ----------------------------------------------------------------------------------

_NARROW = "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM {lineitem}"
query("d1_dedup_rows", f"SELECT DISTINCT * FROM ({_NARROW})")(
    lambda spark, sf: dedup.deduplicate(view(spark, sf, _NARROW)).df
)
query("d1_dedup_rows_removed", f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_NARROW}))) AS rows_affected FROM lineitem")(
    lambda spark, sf: dedup.deduplicate(view(spark, sf, _NARROW)).metrics
)
query(
    "d1_dedup_by_text",
    """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
       WHERE rn = 1""",
)(lambda spark, sf: dedup.deduplicate(table(spark, sf, "documents"), subset=["text"], order_by="doc_id").df)
query(
    "d1_dedup_by_two_columns",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part)
       WHERE rn = 1""",
)(lambda spark, sf: dedup.deduplicate(table(spark, sf, "part"), subset=["p_name", "p_brand"], order_by="p_partkey").df)

# -- similarity in SQL ----------------------------------------------------------------------


def similarity(a: str, b: str) -> str:
    """1 - (n + m - 2 c) / (n + m) in SQL; c by the row-wise table of common subsequence lengths.

    A table row is a list that starts with 0. Lists of one number stand for the characters, since
    a fold keeps to one element type.
    """
    cell = "CASE WHEN unicode({b}[len(row)]) = ch[1] THEN above[len(row)] + 1 ELSE greatest(above[len(row) + 1], row[-1]) END"
    row = f"list_reduce(list_transform(range(length({b})), lambda j: [0]), lambda row, j: list_append(row, {cell.format(b=b)}), [0])"
    last = f"""list_reduce(list_transform(string_split({a}, ''), lambda x: [unicode(x)]), lambda above, ch: {row},
                 list_transform(range(length({b}) + 1), lambda j: 0))[-1]"""
    n = f"(length({a}) + length({b}))"
    return f"(1.0::DOUBLE - ({n} - 2 * {last})::DOUBLE / {n})"


def greedy(items: str, pairs: str) -> str:
    """CTEs that walk items 1..n by rank: ``led(i, leader)`` gives each item its leader.

    ``items`` has i; ``pairs`` has u < v for similar items.
    """
    return f"""
      nb AS (SELECT i, coalesce(list(u ORDER BY u) FILTER (u IS NOT NULL), []) AS us
             FROM ({items}) LEFT JOIN ({pairs}) ON v = i GROUP BY i),
      walk(i, leaders, led) AS (
        SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT
        UNION ALL
        SELECT nb.i, CASE WHEN list_has_any(us, leaders) THEN leaders ELSE list_append(leaders, nb.i) END,
               coalesce(list_min(list_intersect(us, leaders)), nb.i)
        FROM walk JOIN nb ON nb.i = walk.i + 1),
      led AS (SELECT i, led AS leader FROM walk WHERE i > 0)"""


def text_walk(source: str, threshold: float, blocked: bool = False) -> str:
    """CTEs over ``source`` (text, first): distinct texts numbered by first, their leaders and scores."""
    same = "AND (CASE WHEN a.text = '' THEN '__' ELSE lower(a.text[1:2]) END) = (CASE WHEN b.text = '' THEN '__' ELSE lower(b.text[1:2]) END)"
    return f"""
      WITH RECURSIVE texts AS MATERIALIZED (
        SELECT text, first, row_number() OVER (ORDER BY first) AS i FROM ({source})),
      scored AS MATERIALIZED (SELECT a.i AS u, b.i AS v, {similarity('a.text', 'b.text')} AS score
        FROM texts a JOIN texts b ON a.i < b.i {same if blocked else ''}),
      {greedy('SELECT i FROM texts', f'SELECT u, v FROM scored WHERE score >= {threshold}')}"""


_NAMES = "SELECT p_name AS text, min(p_partkey) AS first FROM part GROUP BY 1"


@query(
    "d2_dedup_fuzzy",
    text_walk(_NAMES, 0.85)
    + """ SELECT part.* FROM part JOIN texts ON p_partkey = texts.first JOIN led ON led.i = texts.i WHERE led.leader = led.i""",
)
def d2(spark, sf):
    return dedup.deduplicate(table(spark, sf, "part"), "fuzzy", ["p_name"], 0.85, order_by="p_partkey").df


@query(
    "d2_dedup_fuzzy_low_threshold",
    text_walk(_NAMES, 0.6)
    + """ SELECT part.* FROM part JOIN texts ON p_partkey = texts.first JOIN led ON led.i = texts.i WHERE led.leader = led.i""",
)
def d2_low(spark, sf):
    return dedup.deduplicate(table(spark, sf, "part"), "fuzzy", ["p_name"], 0.6, order_by="p_partkey").df


@query(
    "d3_dedup_fuzzy_blocked",
    text_walk(_NAMES, 0.6, blocked=True)
    + """ SELECT part.* FROM part JOIN texts ON p_partkey = texts.first JOIN led ON led.i = texts.i WHERE led.leader = led.i""",
)
def d3(spark, sf):
    return dedup.deduplicate(table(spark, sf, "part"), "fuzzy", ["p_name"], 0.6, order_by="p_partkey", block_by=["lower(substr(text, 1, 2))"]).df


# Some hundred texts that are alike in parts, and their claims.
_LABELS = "SELECT concat(p_name, ' ', p_type) AS label, min(p_partkey) AS first FROM {part} GROUP BY 1"


@query(
    "d2_dedup_fuzzy_labels",
    text_walk(plain("SELECT label AS text, first FROM (" + _LABELS + ")"), 0.8)
    + """ SELECT part.p_partkey, texts.text AS label FROM part JOIN texts ON p_partkey = texts.first JOIN led ON led.i = texts.i WHERE led.leader = led.i""",
)
def d2_labels(spark, sf):
    parts = view(spark, sf, "SELECT p_partkey, concat(p_name, ' ', p_type) AS label FROM {part}")
    return dedup.deduplicate(parts, "fuzzy", ["label"], 0.8, order_by="p_partkey").df


# Too many names to compare in SQL; tests check it against a plain loop on a small table.
@query("d2_dedup_fuzzy_many_names")
def d2_many(spark, sf):
    return dedup.deduplicate(table(spark, sf, "customer"), "fuzzy", ["c_name"], 0.85, order_by="c_custkey").df


@query(
    "d5_text_similarity",
    f"SELECT p_partkey, round({similarity('p_name', 'p_type')}, 9) AS score FROM part",
)
def d5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(text_similarity("p_name", "p_type"), 9).alias("score"))


@query(
    "d9_fuzzy_matches",
    text_walk(_NAMES, 0.85)
    + """ SELECT a.text, b.text AS kept_text, round(score, 9) AS score FROM led JOIN texts a ON a.i = led.i JOIN texts b ON b.i = led.leader
          JOIN scored ON u = led.leader AND v = led.i WHERE led.leader <> led.i""",
)
def d9(spark, sf):
    out = dedup.fuzzy_matches(table(spark, sf, "part"), ["p_name"], 0.85, order_by="p_partkey")
    return out.withColumn("score", F.round("score", 9))


# -- semantic -------------------------------------------------------------------------------

def vector_walk(threshold: float) -> str:
    return f"""
      WITH RECURSIVE vecs AS MATERIALIZED (
        SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
      scored AS MATERIALIZED (SELECT a.i AS u, b.i AS v, list_cosine_similarity(a.e, b.e) AS score FROM vecs a JOIN vecs b ON a.i < b.i),
      {greedy('SELECT i FROM vecs', f'SELECT u, v FROM scored WHERE score >= {threshold}')}"""


@query(
    "d6_dedup_semantic",
    vector_walk(0.35) + " SELECT vec_id, label FROM embeddings JOIN vecs USING (vec_id) JOIN led USING (i) WHERE led.leader = led.i",
)
def d6(spark, sf):
    # No pair of these vectors reaches the usual 0.92.
    out = dedup.deduplicate_semantic(table(spark, sf, "embeddings"), threshold=0.35, order_by="vec_id", embedding="embedding").df
    return out.select("vec_id", F.col("label"))


@query(
    "d9_semantic_matches",
    vector_walk(0.35)
    + """ SELECT a.vec_id AS removed, b.vec_id AS kept, round(score, 6) AS score FROM led JOIN vecs a ON a.i = led.i
          JOIN vecs b ON b.i = led.leader JOIN scored ON u = led.leader AND v = led.i WHERE led.leader <> led.i""",
)
def d9_semantic(spark, sf):
    out = dedup.semantic_matches(table(spark, sf, "embeddings"), threshold=0.35, order_by="vec_id", embedding="embedding")
    return out.select(F.col("removed.o0").alias("removed"), F.col("kept.o0").alias("kept"), F.round("score", 6).alias("score"))


@query(
    "d7_semantic_without_model",
    text_walk(_NAMES, 0.92)
    + """ SELECT part.* FROM part JOIN texts ON p_partkey = texts.first JOIN led ON led.i = texts.i WHERE led.leader = led.i""",
)
def d7(spark, sf):
    return dedup.deduplicate_semantic(table(spark, sf, "part"), ["p_name"], order_by="p_partkey").df


# The vectors of hashed n-grams, in SQL.
_HASHED = f"""
  WITH RECURSIVE texts AS MATERIALIZED (SELECT text, first, row_number() OVER (ORDER BY first) AS i FROM ({_NAMES})),
  parts AS (SELECT p_partkey, i FROM part JOIN texts ON p_name = text),
  marked AS (SELECT i, ' ' || lower(text) || ' ' AS body FROM texts),
  digests AS (SELECT i, md5(substr(body, j, 3)) AS h FROM (SELECT i, body, unnest(range(1, length(body) - 1)) AS j FROM marked)),
  grams AS (SELECT i, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS b, CASE WHEN CAST('0x' || substr(h, 9, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM digests),
  weights AS (SELECT b, ln((1 + (SELECT count(*) FROM part)) / (1.0 + count(DISTINCT p_partkey))) + 1 AS w FROM grams JOIN parts USING (i) GROUP BY b),
  vecs AS MATERIALIZED (SELECT i, b, sum(s) * any_value(w) AS x FROM grams JOIN weights USING (b) GROUP BY i, b),
  norms AS (SELECT i, sqrt(sum(x * x)) AS norm FROM vecs GROUP BY i),
  scored AS MATERIALIZED (SELECT u, v, dot / (a.norm * c.norm) AS score FROM (
      SELECT p.i AS u, q.i AS v, sum(p.x * q.x) AS dot FROM vecs p JOIN vecs q ON p.b = q.b AND p.i < q.i GROUP BY 1, 2)
    JOIN norms a ON a.i = u JOIN norms c ON c.i = v),
  {greedy('SELECT i FROM texts', 'SELECT u, v FROM scored WHERE score >= 0.6')}"""


@query(
    "d7_semantic_hashed",
    _HASHED + " SELECT part.* FROM part JOIN texts ON p_partkey = texts.first JOIN led ON led.i = texts.i WHERE led.leader = led.i",
)
def d7_hashed(spark, sf):
    return dedup.deduplicate_semantic(table(spark, sf, "part"), ["p_name"], 0.6, order_by="p_partkey", embed="hashed").df


# -- spellings ------------------------------------------------------------------------------

def merge_walk(source: str, column: str, threshold: float = 0.8) -> str:
    """CTEs over ``source``: ``merged(value, canonical)`` for every value of the column."""
    return f"""
      WITH RECURSIVE src AS ({source}),
      vals AS (SELECT {column} AS value, count(*) AS n FROM src WHERE {column} IS NOT NULL GROUP BY 1),
      texts AS MATERIALIZED (SELECT value, lower(value) AS text, row_number() OVER (ORDER BY n DESC, value) AS i FROM vals),
      {greedy('SELECT i FROM texts', f"SELECT a.i AS u, b.i AS v FROM texts a JOIN texts b ON a.i < b.i WHERE {similarity('a.text', 'b.text')} >= {threshold}")},
      merged AS (SELECT a.value, b.value AS canonical FROM led JOIN texts a ON a.i = led.i JOIN texts b ON b.i = led.leader)"""


@query(
    "d8_merge_spellings",
    merge_walk("SELECT * FROM part", "p_name") + " SELECT p_partkey, p_brand, canonical AS p_name FROM src JOIN merged ON p_name = value",
)
def d8(spark, sf):
    return dedup.standardize(table(spark, sf, "part"), "p_name").df.select("p_partkey", "p_brand", "p_name")


@query(
    "d8_merge_case_variants",
    merge_walk(plain(DIRTY_CUSTOMER), "c_mktsegment")
    + " SELECT c_custkey, canonical AS c_mktsegment FROM src LEFT JOIN merged ON c_mktsegment = value",
)
def d8_case(spark, sf):
    return dedup.standardize(view(spark, sf, DIRTY_CUSTOMER), "c_mktsegment").df.select("c_custkey", "c_mktsegment")


@query(
    "d8_merge_metrics",
    merge_walk("SELECT * FROM part", "p_name")
    + """ SELECT count(DISTINCT value) AS before_unique, count(DISTINCT canonical) AS after_unique, count_if(value <> canonical) AS rows_affected
          FROM src JOIN merged ON p_name = value""",
)
def d8_metrics(spark, sf):
    return dedup.standardize(table(spark, sf, "part"), "p_name").metrics
