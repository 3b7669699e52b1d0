"""Join of intervals that overlap, as an equi-join.

The number line is cut into buckets, of twice the width at each level. An interval's own level is
the first whose buckets are as wide as it is long, so it touches at most two of them. A pair meets
at the coarser of its two levels, in the first bucket that both touch, and nowhere else; there the
exact condition is tested. Long and short intervals may be mixed freely.

``overlap_summary`` counts pairs without listing them: rows of one span are joined as one, so the
work follows the distinct spans that meet, not the rows that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.functions.types import col, fresh_name


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals share a point; all columns of both sides, whose names must differ.

    Spans are SQL expressions of (start, end), numbers. An interval with a null end, or one that ends
    before it starts, meets nothing. ``width`` is that of the finest buckets, by default the mean
    length; it steers cost only.
    """
    clash = sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns})
    if clash:
        raise ValueError(f"Both sides have columns named {', '.join(clash)}.")
    names = {}
    for n in ("a_start", "a_end", "a_level", "a_first", "b_start", "b_end", "b_level", "b_first", "level", "bucket", "b_of_level", "b_bucket"):
        names[n] = fresh_name(left, fresh_name(right, f"__{n}"))

    def spanned(df: DataFrame, side: str, span: tuple[str, str]) -> DataFrame:
        start, end = (F.expr(e).cast("double") for e in span)
        return df.withColumns({names[f"{side}_start"]: start, names[f"{side}_end"]: end}).where(F.col(names[f"{side}_start"]) <= F.col(names[f"{side}_end"]))

    def length(side: str) -> Column:
        return F.col(names[f"{side}_end"]) - F.col(names[f"{side}_start"])

    a, b = spanned(left, "a", left_span), spanned(right, "b", right_span)
    if width is None:
        sums = [df.agg(F.sum(length(s)).alias("total"), F.count(F.lit(1)).alias("n")) for df, s in ((a, "a"), (b, "b"))]
        total, n = sums[0].unionAll(sums[1]).agg(F.sum("total"), F.sum("n")).first()
        width = (total or 0.0) / n if n else 0.0
    width = width if width > 0 else 1.0

    def level(side: str) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length(side) / width, F.lit(1.0))))).cast("int")

    a, b = a.withColumn(names["a_level"], level("a")), b.withColumn(names["b_level"], level("b"))
    # A level doubles the width, so there are no more than a double has powers of two.
    levels = sorted({r[0] for df, s in ((a, "a"), (b, "b")) for r in df.select(names[f"{s}_level"]).distinct().collect()})
    if not levels:
        levels = [0]

    def listed(df: DataFrame, side: str, at: str, bucket: str) -> DataFrame:
        coarser = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(names[f"{side}_level"]))
        df = df.withColumn(names[at], F.explode(coarser))
        wide = F.lit(width) * F.pow(F.lit(2.0), F.col(names[at]))
        first, last = (F.floor(F.col(names[f"{side}_{e}"]) / wide) for e in ("start", "end"))
        return df.withColumn(names[f"{side}_first"], first).withColumn(names[bucket], F.explode(F.sequence(first, last)))

    a, b = listed(a, "a", "level", "bucket"), listed(b, "b", "b_of_level", "b_bucket")
    c = {k: F.col(v) for k, v in names.items()}
    pairs = a.join(b, (c["level"] == c["b_of_level"]) & (c["bucket"] == c["b_bucket"])).where(
        (F.greatest(c["a_level"], c["b_level"]) == c["level"])
        & (F.greatest(c["a_first"], c["b_first"]) == c["bucket"])
        & (c["a_start"] <= c["b_end"])
        & (c["b_start"] <= c["a_end"])
    )
    return pairs.drop(*names.values())


def overlap_summary(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], left_key: str, right_key: str) -> DataFrame:
    """Per key of ``left``: its column, ``n`` and ``last_key`` of the pairs of overlap_join whose keys differ.

    ``n`` counts the pairs, ``last_key`` is the greatest key of ``right`` among them. Keys are columns
    of one type; they may repeat, and a null key meets nothing, as in SQL. Keys without a pair are left out.
    """

    def spans(df: DataFrame, side: str, key: str, span: tuple[str, str]) -> DataFrame:
        start, end = (F.expr(e).cast("double").alias(f"{side}_{at}") for e, at in zip(span, ("start", "end")))
        df = df.select(col(key).alias(f"{side}_key"), start, end).where(f"{side}_key is not null and {side}_start <= {side}_end")
        return df.groupBy(f"{side}_key", f"{side}_start", f"{side}_end").agg(F.count(F.lit(1)).alias(f"{side}_rows"))

    a, b = spans(left, "a", left_key, left_span), spans(right, "b", right_key, right_span)
    a_span, b_span = ["a_start", "a_end"], ["b_start", "b_end"]
    # The two greatest keys of a span: one of them differs from any key.
    greatest = b.withColumn("place", F.row_number().over(Window.partitionBy(*b_span).orderBy(F.desc("b_key")))).where("place <= 2")
    met = stage(overlap_join(a.select(*a_span).distinct(), b.groupBy(*b_span).agg(F.sum("b_rows").alias("met")), tuple(a_span), tuple(b_span)), "spans")
    counts = met.groupBy(*a_span).agg(F.sum("met").alias("met"))
    keys = met.join(greatest, b_span).groupBy(*a_span, "b_key").agg(F.lit(1).alias("one"))
    keys = keys.withColumn("place", F.row_number().over(Window.partitionBy(*a_span).orderBy(F.desc("b_key")))).where("place <= 2")
    summed = counts.join(keys.groupBy(*a_span).agg(F.max("b_key").alias("top"), F.min("b_key").alias("next")), a_span)
    # Rows of the key itself are counted with the others and taken off.
    own = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
    own = own.groupBy("a_key", *a_span).agg(F.sum("b_rows").alias("own"))
    rest = a.join(summed, a_span).join(own, ["a_key", *a_span], "left").withColumn("others", F.col("met") - F.coalesce("own", F.lit(0)))
    last = F.when(F.col("top") == F.col("a_key"), F.col("next")).otherwise(F.col("top"))
    found = rest.where("others > 0").groupBy("a_key").agg(F.sum(F.col("a_rows") * F.col("others")).alias("n"), F.max(last).alias("last_key"))
    return found.withColumnRenamed("a_key", left_key)
