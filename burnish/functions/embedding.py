"""Embedding of texts without a model: signed hashing of character n-grams.

Each n-gram adds to, or takes from, one of a few coordinates, both told by its MD5. A coordinate
weighs less the more texts touch it. Texts that share most n-grams point the same way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, GRAM = 64, 3
_REMEMBERED = 200_000


def marked(text: Column) -> Column:
    """Lower-cased, with a space at both ends, so that short texts have n-grams too."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def coordinates(text: Column, width: int, gram: int) -> Column:
    """The distinct coordinates that a text touches."""
    body = marked(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(body) - (gram - 1), F.lit(1)))
    place = lambda i: F.conv(F.substring(F.md5(F.substr(body, i, F.lit(gram)).cast("binary")), 1, 8), 16, 10).cast("long") % width
    return F.array_distinct(F.transform(starts, place))


def hashed_embedding(df: DataFrame, text: Column, width: int = WIDTH, gram: int = GRAM) -> Callable[[Column], Column]:
    """A function from a text column to its vectors, weighted by how many texts of ``df`` touch each coordinate.

    The weights are ``width`` numbers from one pass over ``df``. A null text has a zero vector.
    """
    touched = df.select(F.explode(coordinates(F.coalesce(text, F.lit("")), width, gram)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    n = df.count()
    weights = np.full(width, math.log(1 + n) + 1)
    for r in touched.collect():
        weights[r["at"]] = math.log((1 + n) / (1 + r["n"])) + 1

    def embed(column: Column) -> Column:
        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, tuple[int, int]] = {}

            def coded(g: str) -> tuple[int, int]:
                if g not in known:
                    if len(known) > _REMEMBERED:
                        known.clear()
                    digest = hashlib.md5(g.encode()).hexdigest()
                    known[g] = int(digest[:8], 16) % width, 1 if int(digest[8], 16) % 2 else -1
                return known[g]

            for batch in batches:
                out = []
                for body in batch:
                    vector = np.zeros(width)
                    for i in range(max(len(body) - gram + 1, 1) if body is not None else 0):
                        at, sign = coded(body[i : i + gram])
                        vector[at] += sign * weights[at]
                    out.append(vector.tolist())
                yield pd.Series(out)

        return vectors(marked(column))

    return embed
