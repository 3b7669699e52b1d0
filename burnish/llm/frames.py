"""Helpers shared by the operators: Arrow batches in tasks, and linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from burnish.functions.scratch import stage

#: The bytes of [\\x20\\x09-\\x0D], as in the contracts; the same that bytes.split() splits at.
SPACES = b" \t\n\x0b\x0c\r"


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_batches(df: DataFrame, ddl: str, columns_of: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """A frame with the columns of ``ddl``, made batch by batch; no state crosses batches."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_of(batch), schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def utf8(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``body``: the text as bytes, null as empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return df.select(*keep, body.alias("body"))


def smallest_reachable(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b): root is the smallest node reachable.

    Alternates two rewritings until every node points at its root: each node's larger neighbours
    move to its smallest neighbour, then its smaller neighbours do. The number of rounds grows with
    the logarithm of the longest chain. A node's neighbours are never gathered: minima are partial
    aggregates and the rewriting is a join, so a node with very many links is spread. Each round is
    written to the shared scratch folder.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), label)
    seen = None
    while True:
        # v > u in every row. Large step: larger neighbours of x go to the least of x and its neighbours.
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).union(links.select("u", "v"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = large.where("u <> v").distinct()
        # Small step: smaller neighbours of v, and v itself, go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", "m"))
        links = stage(small.where("u <> v").distinct(), label)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = links.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
            return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
        seen = state
