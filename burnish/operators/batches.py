"""Greedy leader clustering by batches of the lowest-ranked items.

The few lowest-ranked open items settle among themselves: whoever is unclaimed leads and claims the
later ones. Their leaders then go to all tasks and claim from all open items, each task comparing
its rows in tiles. What a batch claims is gone, so where clusters are large a few batches do;
where nothing is similar each batch only takes itself away, and the caller goes on with signatures.
A batch with few leaders for its size makes the next one larger. Whatever the batches, the leaders are
the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from burnish.functions.scratch import stage

#: Most items and bytes of a batch; rows of a task and of a tile.
BATCH, BATCH_BYTES, TASK_ROWS, TILE = 2_048, 4 << 20, 50_000, 4_096
#: Batches go on while this many or fewer are open, or while each claims at least this part of what is open,
#: or if, at the pace of the last, so many more will do and cost an item no more comparisons than those.
FEW_OPEN, PAYS, MORE = 50_000, 0.25, 64
#: A batch grows by GROWS, to MOST times BATCH, while it has so many items for each leader.
GROWS, MOST, CROWDED = 4, 16, 16


class Tile(Protocol):
    """Some items, made ready to be compared."""

    def similar(self, other: Tile, one: int, rows: np.ndarray) -> np.ndarray:
        """Which of the own ``rows`` are similar to the item ``one`` of ``other``."""


def settle(tile: Tile, n: int, most: int | None = None) -> np.ndarray:
    """The leader of each of ``n`` items in order of rank, as places; ends before a leader more than ``most``."""
    led, leaders = np.full(n, -1), 0
    for i in range(n):
        if led[i] < 0:
            if leaders == most:
                return led[:i]
            led[i], leaders = i, leaders + 1
            rest = np.flatnonzero(led[i + 1 :] < 0) + i + 1
            if len(rest):
                led[rest[tile.similar(tile, i, rest)]] = i
    return led


def claimed(tile: Tile, n: int, leaders: Tile, n_leaders: int) -> np.ndarray:
    """The first leader similar to each of ``n`` items, as a place; -1 without one."""
    led, rest = np.full(n, -1), np.arange(n)
    for i in range(n_leaders):
        if not len(rest):
            break
        hit = tile.similar(leaders, i, rest)
        led[rest[hit]] = i
        rest = rest[~hit]
    return led


def batch_leaders(items: DataFrame, tile_of: Callable[[pa.Table], Tile], size: Column, assign: bool) -> tuple[DataFrame, DataFrame | None]:
    """``id, leader`` of the items settled by batches, and the items left open, if any.

    ``items`` is a written table of ``id`` (the rank) and what ``tile_of`` reads; ``size`` says how
    many bytes an item takes. Without ``assign`` the leader of a claimed item is null.
    """
    spark, columns = items.sparkSession, items.columns
    out_schema = StructType([*items.schema.fields, StructField("leader", LongType())])
    settled: list[DataFrame] = []
    rest, left, batch = items, items.count(), BATCH
    while left:
        low = rest.select("id", size.cast("long").alias("size")).orderBy("id").limit(batch).toArrow()
        fits = max(1, int((np.cumsum(low.column("size").to_numpy()) <= BATCH_BYTES).sum()))
        last = low.column("id")[fits - 1].as_py()
        heads = rest.where(F.col("id") <= last).toArrow().sort_by("id")
        # A larger batch takes fewer leaders, so that no more is compared in one.
        led = settle(tile_of(heads), len(heads), max(1, BATCH * BATCH // max(BATCH, len(heads))))
        heads = heads.slice(0, len(led))
        ids = heads.column("id").to_numpy()
        last = int(ids[-1])
        first = np.flatnonzero(led == np.arange(len(led)))
        owner = [int(ids[at]) if assign or at == i else None for i, at in enumerate(led.tolist())]
        settled.append(spark.createDataFrame(pa.table({"id": ids, "leader": pa.array(owner, pa.int64())})))
        left -= len(heads)
        if not left:
            break
        leaders = heads.take(pa.array(first))
        leader_ids = leaders.column("id").to_numpy()

        def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = tile_of(leaders)
            for batch in batches:
                for start in range(0, batch.num_rows, TILE):
                    part = batch.slice(start, TILE)
                    at = claimed(tile_of(pa.Table.from_batches([part])), part.num_rows, known, len(leader_ids))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leader_ids[at], pa.int64(), mask=at < 0)], [*columns, "leader"])

        later = rest.where(F.col("id") > last)
        tasks = max(spark.sparkContext.defaultParallelism, left // TASK_ROWS)
        met = stage(later.repartition(tasks).mapInArrow(claim, out_schema), "batch")
        taken = met.where("leader is not null")
        settled.append(taken.select("id", F.col("leader") if assign else F.lit(None).cast("long").alias("leader")))
        before, rest = left, met.where("leader is null").drop("leader")
        left = rest.count()
        done = before - left + len(heads)
        pays = before - left >= PAYS * before or (left <= MORE * done and left * len(first) <= BATCH / PAYS * done)
        grown = min(batch * GROWS, BATCH * MOST) if len(heads) == batch >= CROWDED * len(first) else batch
        if left > FEW_OPEN and not pays and grown == batch:
            break
        batch = grown
    result = settled[0]
    for more in settled[1:]:
        result = result.unionAll(more)
    return result, rest if left else None
