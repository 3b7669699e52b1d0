"""Greedy leader clustering without comparing everything with everything.

Walk the items by rank: an item nobody has claimed becomes a leader and claims every later item
similar to it. The outcome is the lexicographically first maximal independent set of the
similarity graph, found here in rounds (cf. Blelloch, Fineman, Shun, SPAA 2012).

Items carry signatures; similar items share at least one. In each round only the ``heads``, the
few lowest-ranked open items of every signature, are compared with one another. A head that heads
all its signatures has met every smaller item it could be similar to, so it can be settled. The
new leaders then claim from all open items. One leader of a large cluster removes the cluster in a
single pass, so work follows leaders x items, and no pair list of a group is ever built.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.scratch import stage

GROUP_ROWS = 50_000
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


@dataclass(frozen=True)
class Matcher:
    """How items are compared.

    ``within(heads)`` gives the similar pairs (u, v), u < v, among rows that share ``sig``, for
    those v marked ``complete``;
    ``nearest(leaders, items, keys)`` gives (id, leader): for each item some row per group of
    ``keys`` with its smallest similar leader, where there is one.
    """

    within: Callable[[DataFrame], DataFrame]
    nearest: Callable[[DataFrame, DataFrame, list[str]], DataFrame]
    first_heads: int = 64
    most_heads: int = 16_384


@contextmanager
def _early_group_limit(spark, rows: int):
    """Let a 'first n of each group' filter run before the shuffle for n up to ``rows``."""
    old = spark.conf.get(GROUP_LIMIT_SETTING)
    spark.conf.set(GROUP_LIMIT_SETTING, str(max(rows, int(old))))
    try:
        yield
    finally:
        spark.conf.set(GROUP_LIMIT_SETTING, old)


def _without(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(column)), column, "left_anti")


class _Chunks:
    """Splits signatures with very many items into chunks, and copies their leaders to each."""

    def __init__(self, postings: DataFrame):
        self.needed = False
        if postings.count() > GROUP_ROWS:
            sizes = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS)
            self.hot = stage(sizes.select("sig", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts")), "hot")
            self.needed = not self.hot.isEmpty()

    def items(self, df: DataFrame) -> DataFrame:
        if not self.needed:
            return df
        chunk = F.pmod(F.xxhash64("id"), F.col("parts"))
        return df.join(self.hot, "sig", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)).cast("int")).drop("parts")

    def leaders(self, df: DataFrame) -> DataFrame:
        if not self.needed:
            return df
        parts = F.coalesce(F.col("parts"), F.lit(1))
        return df.join(self.hot, "sig", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    @property
    def keys(self) -> list[str]:
        return ["sig", "chunk"] if self.needed else ["sig"]


def _settle(complete: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaders and claimed ids among the heads, as far as ``complete`` heads can be decided.

    A complete head that no open smaller neighbour blocks leads and claims its neighbours, which
    unblocks others; one written table of claimed ids per step carries this on.
    """

    def leading(taken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        free = pairs if taken is None else _without(_without(pairs, taken, "u"), taken, "v")
        rest = complete if taken is None else _without(complete, taken)
        return _without(rest, free.select(F.col("v").alias("id")).distinct()), free

    if pairs.isEmpty():
        return complete, complete.limit(0)
    taken, size = None, 0
    while True:
        new, free = leading(taken)
        more = free.join(new.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        taken = stage(more if taken is None else taken.unionAll(more), "claimed")
        grown = taken.count()
        if grown == size:
            return stage(leading(taken)[0], "leaders"), taken
        size = grown


def greedy_leaders(items: DataFrame, matcher: Matcher, assign: bool = False) -> DataFrame:
    """(id, leader) for every item; leader = id for the leaders themselves.

    ``items`` holds ``id`` (its rank, a long), ``signatures`` (array of long, never empty) and
    what the matcher reads. With ``assign`` a claimed item gets its smallest similar leader;
    otherwise its leader is null and less is compared.
    """
    postings = stage(
        items.withColumn("n_sig", F.size(F.array_distinct("signatures")))
        .withColumn("sig", F.explode(F.array_distinct("signatures")))
        .drop("signatures"),
        "postings",
    )
    spark = postings.sparkSession
    chunks = _Chunks(postings)
    open_items, heads, first = postings, matcher.first_heads, True
    all_leaders, all_claims = [], []
    while True:
        with _early_group_limit(spark, heads):
            place = F.row_number().over(Window.partitionBy("sig").orderBy("id"))
            top = open_items.withColumn("place", place).where(F.col("place") <= heads).drop("place")
            headed = F.count(F.lit(1)).over(Window.partitionBy("id"))
            top = stage(top.withColumn("complete", headed == F.col("n_sig")), "heads")
        # Counts of written tables come from file footers.
        everything = top.count() == open_items.count()
        complete = stage(top.where("complete").select("id").distinct(), "complete")
        pairs = stage(matcher.within(top), "pairs")
        leaders, claimed = _settle(complete, pairs)

        if everything and first:
            met = pairs.join(leaders.withColumnRenamed("id", "u"), "u", "left_semi")
            found = met.select(F.col("v").alias("id"), F.col("u").alias("leader"))
        elif everything and not assign:
            found = claimed.select("id", F.lit(None).cast("long").alias("leader"))
        else:
            # With assign, earlier claims meet the new leaders too: one of them may rank lower.
            rest = postings if assign else _without(_without(open_items, complete), claimed)
            leader_rows = open_items.join(leaders, "id", "left_semi")
            found = matcher.nearest(chunks.leaders(leader_rows), chunks.items(_without(rest, leaders)), chunks.keys)
            if not assign:
                found = found.unionAll(claimed.select("id", F.lit(None).cast("long").alias("leader")))
        found = stage(found.groupBy("id").agg(F.min("leader").alias("leader")), "claims")
        all_leaders.append(leaders)
        all_claims.append(found)
        if everything:
            break
        settled = leaders.unionAll(found.select("id"))
        before, open_items = open_items.count(), stage(_without(open_items, settled), "open")
        left = open_items.count()
        if not left:
            break
        # Dense data shrinks fast under few leaders; only sparse data needs more heads.
        if 2 * left > before:
            heads = min(heads * 4, matcher.most_heads)
        first = False

    kept = reduce(DataFrame.unionAll, all_leaders).select("id", F.col("id").alias("leader"))
    claims = reduce(DataFrame.unionAll, all_claims).groupBy("id").agg(F.min("leader").alias("leader"))
    return kept.unionAll(claims if assign else claims.select("id", F.lit(None).cast("long").alias("leader")))
