"""Remove duplicate rows: exact, by text similarity, by embedding similarity; merge spellings."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.embedding import hashed_embedding
from burnish.functions.ordering import with_rank
from burnish.functions.scratch import spread, stage
from burnish.functions.similarity import TextTile, lengths_fit, may_be_similar, text_signatures, text_similarity
from burnish.functions.text import comparison_columns, composite_text
from burnish.functions.types import col, fresh_name, is_text, require_column, require_order
from burnish.operators.batches import batch_leaders
from burnish.operators.columns import CASINGS, change_case
from burnish.operators.leaders import Matcher, greedy_leaders
from burnish.operators.outcome import Outcome, column_change, rows_removed
from burnish.operators.vectors import VectorTile, vector_items, vector_matcher

FUZZY_THRESHOLD = 0.85
SEMANTIC_THRESHOLD = 0.92
MERGE_THRESHOLD = 0.80


# -- text items -----------------------------------------------------------------------------

def text_matcher(texts: DataFrame, threshold: float, rows: int) -> Matcher:
    """Compares texts by id. What meets under signatures is ids and lengths; ``texts`` (id, text)
    are looked up once for each pair whose lengths fit, so long texts are not copied around."""

    def pick(df: DataFrame, suffix: str, name: str, keys: list[str]) -> DataFrame:
        wanted = [F.col("id").alias(name), F.col("block").alias(f"block_{suffix}"), F.col("length").alias(f"length_{suffix}")]
        return spread(df.select(*keys, *wanted), rows, *keys)

    def met(a: DataFrame, b: DataFrame, low: str, high: str, keys: list[str]) -> DataFrame:
        pairs = pick(a, "a", low, keys).join(pick(b, "b", high, keys), keys)
        fitting = pairs.where(
            (F.col(low) < F.col(high))
            & (F.col("block_a") == F.col("block_b"))
            & lengths_fit(F.col("length_a"), F.col("length_b"), threshold)
        )
        once = fitting.select(low, high).distinct()
        scored = once.join(texts.select(F.col("id").alias(low), F.col("text").alias("text_a")), low).join(
            texts.select(F.col("id").alias(high), F.col("text").alias("text_b")), high
        )
        likely = scored.where(may_be_similar(F.col("text_a"), F.col("text_b"), threshold))
        return likely.where(text_similarity("text_a", "text_b") >= threshold).select(low, high)

    return Matcher(
        within=lambda heads: met(heads, heads.where("complete"), "u", "v", ["sig"]),
        nearest=lambda leaders, items, keys: met(leaders, items, "leader", "id", keys).select("id", "leader"),
    )


def text_leaders(
    texts: DataFrame, order: list[Column], threshold: float, assign: bool
) -> tuple[DataFrame, DataFrame]:
    """Greedy leaders among distinct texts ranked by ``order``.

    ``texts`` holds text, block and whatever else is wanted back. Returns the texts with their
    rank ``id``, and (id, leader).
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1].")
    vertices = with_rank(texts, order, "id")

    def tile_of(rows: pa.Table) -> TextTile:
        return TextTile(rows.column("text").to_pylist(), rows.column("block").to_pylist(), threshold)

    result, rest = batch_leaders(vertices.select("id", "block", "text"), tile_of, 4 * F.length("text") + 64, assign)
    if rest is not None:
        matcher = text_matcher(rest.select("id", "text"), threshold, rest.count())
        result = result.unionAll(greedy_leaders(text_signatures(rest, threshold), matcher, assign))
    return vertices, result


# -- duplicate rows -------------------------------------------------------------------------

def deduplicate(
    df: DataFrame,
    strategy: str = "exact",
    subset: list[str] | None = None,
    threshold: float = FUZZY_THRESHOLD,
    order_by=None,
    block_by: list[str] = (),
) -> Outcome:
    """Keep the first row of each group of duplicates.

    ``exact`` compares whole rows, or ``subset`` with the first row under ``order_by`` kept.
    ``fuzzy`` compares the text of ``subset`` (all text columns by default); with
    ``block_by`` (SQL expressions over ``text``, the compared text) only texts that agree in all of
    them. ``order_by`` must be unique and is required whenever position decides.
    """
    details = {"strategy": strategy, "subset": subset, "threshold": threshold}
    if strategy == "exact":
        after = df.dropDuplicates() if subset is None else first_rows(df, subset, order_by)
    elif strategy == "fuzzy":
        columns = comparison_columns(df, subset)
        if not columns:
            return Outcome(df, "deduplicate_fuzzy", details=details, template="No text columns to compare.")
        texts = composite_texts(df, columns, order_by, block_by)
        order = [F.col("first"), F.col("text")]
        vertices, result = text_leaders(texts, order, threshold, assign=False)
        kept = vertices.join(result.where("leader IS NOT NULL").select("id"), "id", "left_semi")
        after = rows_of(df, kept, columns, order_by)
    else:
        raise ValueError(f"No strategy named {strategy!r}: exact and fuzzy are known.")
    return Outcome(
        after, f"deduplicate_{strategy}", rows_removed(df, after), details, "Removed {rows_affected:,} {strategy} duplicate rows."
    )


def first_rows(df: DataFrame, subset: list[str], order_by) -> DataFrame:
    """First row of each key. The filter is applied before the shuffle, so a hot key sends one row per task."""
    order = require_order(order_by, "Keeping the first row of each key")
    place = fresh_name(df, "__place")
    number = F.row_number().over(Window.partitionBy(*[col(c) for c in subset]).orderBy(*order))
    return df.withColumn(place, number).where(F.col(place) == 1).drop(place)


def _order_key(order_by) -> Column:
    order = require_order(order_by, "Keeping the first of similar rows")
    return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])


def composite_texts(df: DataFrame, columns: list[str], order_by, block_by: list[str] = ()) -> DataFrame:
    """Distinct compared texts, each with the order key of its first row and its block."""
    keyed = df.select(composite_text(columns).alias("text"), _order_key(order_by).alias("first"))
    block = F.to_json(F.struct(*[F.expr(e).alias(f"b{i}") for i, e in enumerate(block_by)])) if block_by else F.lit("")
    return keyed.groupBy("text").agg(F.min("first").alias("first")).withColumn("block", block)


def rows_of(df: DataFrame, kept: DataFrame, columns: list[str], order_by) -> DataFrame:
    """The first row of each kept text, found by its order key and a hash of the text."""
    text, first = fresh_name(df, "__text"), fresh_name(df, "__first")
    keyed = df.withColumn(text, F.xxhash64(composite_text(columns))).withColumn(first, _order_key(order_by))
    wanted = kept.select(F.xxhash64("text").alias(text), F.col("first").alias(first))
    return keyed.join(wanted, [text, first], "left_semi").drop(text, first)


def fuzzy_matches(
    df: DataFrame,
    subset: list[str] | None = None,
    threshold: float = FUZZY_THRESHOLD,
    order_by=None,
    block_by: list[str] = (),
) -> DataFrame:
    """What fuzzy dedup removes and why: (text, kept_text, score), one line per removed text."""
    columns = comparison_columns(df, subset)
    texts = composite_texts(df, columns, order_by, block_by)
    vertices, result = text_leaders(texts, [F.col("first"), F.col("text")], threshold, assign=True)
    removed = result.where(F.col("leader") != F.col("id"))
    return (
        removed.join(vertices.select("id", "text"), "id")
        .join(vertices.select(F.col("id").alias("leader"), F.col("text").alias("kept_text")), "leader")
        .select("text", "kept_text", text_similarity("text", "kept_text").alias("score"))
    )


# -- embeddings -----------------------------------------------------------------------------

def deduplicate_semantic(
    df: DataFrame,
    subset: list[str] | None = None,
    threshold: float = SEMANTIC_THRESHOLD,
    order_by=None,
    embedding: str | None = None,
    embed: Callable[[Column], Column] | str | None = None,
) -> Outcome:
    """Remove rows whose embedding has cosine >= threshold with an earlier kept row.

    Vectors come from the array column ``embedding`` or from ``embed``, a function from the text
    column to an array column (a pandas UDF around a model), or "hashed" for hashed n-grams, which
    need no model. With neither, texts are compared as in fuzzy dedup without blocking.
    """
    columns = comparison_columns(df, subset)
    details = {"strategy": "semantic", "threshold": threshold, "columns_used": columns}
    if embedding is None and not columns:
        details["reason"] = "no_text_columns"
        return Outcome(df, "deduplicate_semantic", details=details, template="No text columns to compare.")
    if embedding is None and embed is None:
        plain = deduplicate(df, "fuzzy", columns, threshold, order_by)
        return Outcome(plain.df, "deduplicate_semantic", plain.metrics, {**details, "fallback": "fuzzy"}, plain.template)
    vertices, result = vector_leaders(df, columns, threshold, order_by, embedding, embed, assign=False)
    kept = vertices.join(result.where("leader IS NOT NULL").select("id"), "id", "left_semi")
    first = fresh_name(df, "__first")
    wanted = kept.select(F.col("first").alias(first))
    after = df.withColumn(first, _order_key(order_by)).join(wanted, first, "left_semi").drop(first)
    return Outcome(
        after, "deduplicate_semantic", rows_removed(df, after), details, "Removed {rows_affected:,} semantically duplicate rows."
    )


def vector_leaders(df, columns, threshold, order_by, embedding, embed, assign):
    if embedding is None and embed == "hashed":
        embed = hashed_embedding(df, composite_text(columns))
    vector = col(embedding) if embedding else embed(composite_text(columns))
    rows = df.select(_order_key(order_by).alias("first"), vector.cast("array<double>").alias("vector"))
    vertices = with_rank(rows, [F.col("first")], "id")

    def tile_of(rows: pa.Table) -> VectorTile:
        return VectorTile(rows.column("vector"), threshold)

    result, rest = batch_leaders(vertices.select("id", "vector"), tile_of, 8 * F.size("vector") + 64, assign)
    if rest is not None:
        result = result.unionAll(greedy_leaders(vector_items(rest, threshold), vector_matcher(threshold), assign))
    return vertices, result


def semantic_matches(
    df: DataFrame,
    subset: list[str] | None = None,
    threshold: float = SEMANTIC_THRESHOLD,
    order_by=None,
    embedding: str | None = None,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """What semantic dedup removes: order columns of the removed row, of the kept row, cosine."""
    columns = comparison_columns(df, subset)
    vertices, result = vector_leaders(df, columns, threshold, order_by, embedding, embed, assign=True)
    a, b = vertices.select("id", F.col("first").alias("removed"), F.col("vector").alias("x")), vertices.select(
        F.col("id").alias("leader"), F.col("first").alias("kept"), F.col("vector").alias("y")
    )

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    score = dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    return (
        result.where(F.col("leader") != F.col("id"))
        .join(a, "id")
        .join(b, "leader")
        .select("removed", "kept", score.alias("score"))
    )


# -- spellings of one value -----------------------------------------------------------------

def value_map(df: DataFrame, column: str, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """(value, canonical) for the values that change when near spellings are merged.

    Values are compared lower-cased. The more frequent one leads, the smaller one on ties.
    """
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.withColumn("text", F.lower("value")), "values")
    rank = F.struct((-F.col("n")).alias("n"), F.col("value"))
    texts = counts.groupBy("text").agg(F.min(rank).alias("rank")).withColumn("block", F.lit(""))
    vertices, result = text_leaders(texts, [F.col("rank.n"), F.col("rank.value")], threshold, assign=True)
    leaders = vertices.select(F.col("id").alias("leader"), F.col("rank.value").alias("canonical"))
    canonical = result.join(vertices.select("id", "text"), "id").join(leaders, "leader").select("text", "canonical")
    return stage(
        counts.join(canonical, "text").where(F.col("value") != F.col("canonical")).select("value", "canonical"), "map"
    )


def standardize(df: DataFrame, column: str, method: str = "cluster_merge", threshold: float = MERGE_THRESHOLD) -> Outcome:
    """Rewrite a text column in one casing, or merge near spellings into the most frequent one."""
    if method in CASINGS or method != "cluster_merge":
        return change_case(df, column, method)
    if not is_text(require_column(df, column)):
        raise ValueError(f"Column '{column}' is not a string column.")
    merged = fresh_name(df, "__merged")
    mapping = value_map(df, column, threshold)
    # Small maps are broadcast by the planner from the written table's size; large ones are not.
    joined = df.join(
        mapping.select(F.col("value").alias("__value"), F.col("canonical").alias(merged)), col(column) == F.col("__value"), "left"
    ).drop("__value")
    after = F.coalesce(F.col(merged), col(column))
    return Outcome(
        joined.withColumn(column, after).select(*[col(c) for c in df.columns]),
        "standardize",
        column_change(joined, column, after),
        {"column": column, "method": method},
        "Standardized '{column}': {before_unique} -> {after_unique} unique values, {rows_affected:,} cells changed.",
    )
