"""Column profiles that can be stored and merged: exact counts beside sketches of values.

A state is a small table, one line per column. States of parts of a table merge to the state of the
whole, so rows that come later, or columns that change, do not need the rest to be read again.
Counts, extremes and sums are exact; distinct counts come from HyperLogLog sketches (standard error
1.6 %), quartiles from KLL sketches (rank error about 1.7 %).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.types import col, is_numeric, is_text
from burnish.operators.profile import hashable

#: log2 of the buckets of a distinct count, and the size of a sketch of values.
BUCKETS, SKETCH = 12, 200

STATE_SCHEMA = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("name", "dtype")),
        *(T.StructField(n, T.LongType()) for n in ("rows", "nulls")),
        *(T.StructField(n, T.DoubleType()) for n in ("least", "greatest", "total")),
        T.StructField("bytes", T.LongType()),
        *(T.StructField(n, T.BinaryType()) for n in ("distinct", "folded", "spread")),
    ]
)


def _distinct(value: Column) -> Column:
    """A sketch of the values that are not null."""
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), BUCKETS)


def column_states(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One line per column, from one aggregate over the table."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        return df.sparkSession.createDataFrame([], STATE_SCHEMA)
    parts, lines = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        c, number, word = col(f.name), is_numeric(f.dataType), is_text(f.dataType)
        value, amount = hashable(f.name, f.dataType), c.cast("double")
        atomic = isinstance(f.dataType, T.AtomicType)
        size = F.lit(8) if number else F.octet_length(c.cast("string") if atomic else F.to_json(F.struct(c)))
        own = {
            "nulls": F.count_if(c.isNull()),
            "least": F.min(amount) if number else F.lit(None).cast("double"),
            "greatest": F.max(amount) if number else F.lit(None).cast("double"),
            "total": F.sum(amount) if number else F.lit(None).cast("double"),
            "bytes": F.coalesce(F.sum(size), F.lit(0)),
            "distinct": _distinct(value),
            "folded": _distinct(F.lower(c)) if word else F.lit(None).cast("binary"),
            "spread": F.kll_sketch_agg_double(F.when(~F.isnan(amount), amount), SKETCH) if number else F.lit(None).cast("binary"),
        }
        parts += [v.alias(f"{k}{i}") for k, v in own.items()]
        lines.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("rows"), *[F.col(f"{k}{i}").alias(k) for k in own]))
    wide = df.agg(*parts)
    return wide.select(F.explode(F.array(*lines)).alias("s")).select(*[F.col(f"s.{f.name}").cast(f.dataType).alias(f.name) for f in STATE_SCHEMA.fields])


def merge_states(*states: DataFrame) -> DataFrame:
    """The states of the parts of a table as that of the whole. A column that some parts lack counts only where it is."""
    every = reduce(DataFrame.unionByName, [s.select(*STATE_SCHEMA.names) for s in states])
    return every.groupBy("name", "dtype").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls")],
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"), F.sum("bytes").alias("bytes"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.max(F.col("folded").isNotNull()), F.hll_union_agg("folded")).alias("folded"),
        F.when(F.max(F.col("spread").isNotNull()), F.kll_merge_agg_double("spread")).alias("spread"),
    )


def describe_states(states: DataFrame) -> DataFrame:
    """What a state says: counts, extremes, mean, memory, and estimated distinct values and quartiles."""
    filled = F.col("rows") - F.col("nulls")

    def quartile(part: float, name: str) -> Column:
        return F.when(filled > 0, F.kll_sketch_get_quantile_double("spread", F.lit(part))).alias(name)

    return states.select(
        "name", "dtype", F.col("rows").alias("row_count"), F.col("nulls").alias("null_count"),
        F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows") * 100).otherwise(0.0).alias("null_pct"),
        F.hll_sketch_estimate("distinct").alias("unique_estimate"), F.hll_sketch_estimate("folded").alias("folded_estimate"),
        F.col("least").alias("min_value"), F.col("greatest").alias("max_value"), (F.col("total") / filled).alias("mean_value"),
        quartile(0.25, "first_quartile"), quartile(0.5, "median"), quartile(0.75, "third_quartile"), (F.col("bytes") / 2**20).alias("memory_mb"),
    )
