"""Cells and block products that bring similar vectors together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators.leaders import Matcher

CELL_ROWS = 5_000
MOST_PIVOTS = 1_024
BLOCK = 1_024


def _unit(column: pd.Series) -> np.ndarray:
    """Vectors as unit rows; a zero vector stays zero and is similar to nothing."""
    rows = np.stack(column.to_numpy()).astype("float64")
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _inside(unit: np.ndarray, pivots: np.ndarray, reach: float) -> np.ndarray:
    """Which cells each unit vector is listed in: its own, and those whose border is within reach."""
    near = unit @ pivots.T
    home = near.argmax(axis=1)
    between = np.sqrt(np.maximum(2.0 - 2.0 * pivots @ pivots.T, 1e-18))
    # Distance to the plane between home p and another pivot q: (|x-q|^2 - |x-p|^2) / 2|p-q|.
    each = np.arange(len(unit))
    inside = (near[each, home][:, None] - near) / between[home] <= reach
    inside[each, home] = True
    return inside


def _pivots(vertices: DataFrame, reach: float) -> np.ndarray:
    """Distinct unit vectors to partition by: at most MOST_PIVOTS, about one per CELL_ROWS rows.

    With r cells per vector, meeting everything in its cells costs r * r / pivots of meeting
    everything. Of several numbers of pivots the cheapest on a few vectors is taken, or none.
    The choice steers cost only.
    """
    wanted = min(MOST_PIVOTS, math.ceil(vertices.count() / CELL_ROWS))
    if wanted <= 1:
        return np.zeros((0, 0))
    rows = vertices.orderBy(F.xxhash64("id")).limit(2 * wanted).select("vector").toPandas()["vector"]
    points, others = np.unique(_unit(rows[:wanted]), axis=0), _unit(rows[wanted:])
    np.random.default_rng(0).shuffle(points)
    best, least = np.zeros((0, 0)), 1.0
    while len(points) > 1:
        cost = _inside(others, points, reach).sum(axis=1).mean() ** 2 / len(points)
        if cost < least:
            best, least = points, cost
        points = points[: len(points) // 2]
    return best


def vector_items(vertices: DataFrame, threshold: float) -> DataFrame:
    """(id, vector, signatures): the cells of the nearest-pivot partition a vector can matter to.

    A pair with cosine >= t is at most sqrt(2 - 2t) apart. If it falls into two cells, the
    first vector is no further than that from the plane between the two pivots, so it is also
    listed in the second cell. No pair is lost, whatever the data.
    """
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9
    pivots = _pivots(vertices, reach)
    if len(pivots) < 2:
        return vertices.select("id", "vector", F.array(F.lit(0).cast("long")).alias("signatures"))

    @F.pandas_udf("array<long>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.flatnonzero(row) for row in _inside(_unit(batch), pivots, reach)])

    return vertices.select("id", "vector", cells("vector").alias("signatures"))


class VectorTile:
    """Unit vectors side by side."""

    def __init__(self, vectors: pa.ChunkedArray, threshold: float):
        self.rows, self.threshold = _unit(vectors.to_pandas()) if len(vectors) else np.zeros((0, 0)), threshold

    def similar(self, other: VectorTile, one: int, rows: np.ndarray) -> np.ndarray:
        return self.rows[rows] @ other.rows[one] >= self.threshold


def vector_matcher(threshold: float) -> Matcher:
    def within(heads: DataFrame) -> DataFrame:
        def product(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id")
            ids, rows, complete = group["id"].to_numpy(), _unit(group["vector"]), group["complete"].to_numpy()
            us, vs = [], []
            for start in range(0, len(ids), BLOCK):
                u, v = np.nonzero(rows[start : start + BLOCK] @ rows[start:].T >= threshold)
                ahead = (u < v) & complete[start + v]
                us.append(ids[start + u[ahead]])
                vs.append(ids[start + v[ahead]])
            return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

        # A group is at most ``most_heads`` rows.
        pairs = heads.select("sig", "id", "vector", "complete").groupBy("sig").applyInPandas(product, "u long, v long")
        return pairs.distinct()

    def nearest(leaders: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
        def claim(lead: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
            if not len(lead) or not len(rest):
                return pd.DataFrame({"id": pd.Series(dtype="int64"), "leader": pd.Series(dtype="int64")})
            lead = lead.sort_values("id")
            ids, rows, firsts = lead["id"].to_numpy(), _unit(lead["vector"]), []
            for start in range(0, len(rest), BLOCK):
                part = rest.iloc[start : start + BLOCK]
                own = part["id"].to_numpy()
                hits = (_unit(part["vector"]) @ rows.T >= threshold) & (ids[None, :] < own[:, None])
                some = hits.any(axis=1)
                firsts.append(pd.DataFrame({"id": own[some], "leader": ids[hits[some].argmax(axis=1)]}))
            return pd.concat(firsts)

        # Both sides are bounded: leaders by ``most_heads``, items by the chunk size.
        left = leaders.select(*keys, "id", "vector").groupBy(*keys)
        # New names for one side: both stem from the same table.
        right = items.select(*[F.col(c).alias(c) for c in (*keys, "id", "vector")]).groupBy(*keys)
        return left.cogroup(right).applyInPandas(claim, "id long, leader long")

    return Matcher(within, nearest, first_heads=1_024, most_heads=4_096)
