"""Text similarity and the signatures that bring similar texts together.

Similarity of two texts is 1 - d / (n + m), d being the least number of single-character
insertions and deletions that turn one into the other; with c the length of the longest common
subsequence, d = n + m - 2c.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.scratch import stage
from burnish.functions.sequences import LONGEST, common_in_pairs, common_subsequence, common_with_one, numbers_of, spelled

EPSILON = 1e-9
BROADCAST_TOKENS = 200_000


#: Buckets of signs that are counted to bound the difference of two texts.
BUCKETS = 16


def _ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 1.0 if a == b or total == 0 else 1.0 - (total - 2 * common_subsequence(a, b)) / total


class TextTile:
    """Texts side by side. Only texts of one block whose lengths and counts of signs allow it are compared."""

    def __init__(self, texts: list[str], blocks: list[str], threshold: float):
        self.texts, self.blocks, self.threshold = texts, np.array(blocks, object), threshold
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.short = self.lengths <= LONGEST
        self.rows, self.signs, _ = spelled([t if len(t) <= LONGEST else "" for t in texts])
        self.counts = np.stack([self._counted(t) for t in texts]) if texts else np.zeros((0, BUCKETS), np.int64)

    @staticmethod
    def _counted(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.bincount(codes % BUCKETS, minlength=BUCKETS)

    def similar(self, other: TextTile, one: int, rows: np.ndarray) -> np.ndarray:
        n, text = int(other.lengths[one]), other.texts[one]
        total = self.lengths[rows] + n
        apart = np.floor((1.0 - self.threshold) * total + EPSILON)
        may = (np.abs(self.lengths[rows] - n) <= apart) & (self.blocks[rows] == other.blocks[one])
        places = np.flatnonzero(may)
        # An insertion or deletion changes one count by one.
        places = places[np.abs(self.counts[rows[places]] - other.counts[one]).sum(axis=1) <= apart[places]]
        common = np.zeros(len(places), np.int64)
        fast = self.short[rows[places]] if n <= LONGEST else np.zeros(len(places), bool)
        if fast.any():
            few = rows[places[fast]]
            common[fast] = common_with_one(numbers_of(text, self.signs), len(self.signs), self.rows[few, : int(self.lengths[few].max(initial=0))])
        for i in np.flatnonzero(~fast).tolist():
            common[i] = common_subsequence(text, self.texts[rows[places[i]]])
        both = total[places]
        score = 1.0 - (both - 2 * common) / np.maximum(both, 1)
        out = np.zeros(len(rows), bool)
        out[places] = (score >= self.threshold) | (both == 0)
        return out


def text_similarity(a: str, b: str) -> Column:
    """Similarity of two text columns, null when either is."""

    @F.pandas_udf(T.DoubleType())
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            known = np.flatnonzero((left.notna() & right.notna()).to_numpy())
            x, y = ([s.iloc[i] for i in known] for s in (left, right))
            total = np.fromiter((len(p) + len(q) for p, q in zip(x, y)), np.int64, len(known))
            out = np.full(len(left), np.nan)
            out[known] = np.where(total == 0, 1.0, 1.0 - (total - 2 * common_in_pairs(x, y)) / np.maximum(total, 1))
            yield pd.Series(out).astype(object).where(~np.isnan(out), None) if len(known) < len(left) else pd.Series(out)

    return similarity(a, b)


def lengths_fit(n: Column, m: Column, threshold: float) -> Column:
    """Whether texts of n and m characters can reach the threshold.

    A common subsequence is no longer than the shorter text.
    """
    return 2.0 * F.least(n, m) + F.lit(EPSILON) >= F.lit(threshold) * (n + m)


def may_be_similar(a: Column, b: Column, threshold: float) -> Column:
    """Built-in test that no pair at or above the threshold fails.

    The number of insertions and deletions is at least the edit distance, which Spark stops
    computing as soon as it passes the bound.
    """
    n, m = F.length(a), F.length(b)
    bound = F.floor(F.lit(1.0 - threshold) * (n + m) + F.lit(EPSILON)).cast("int")
    return lengths_fit(n, m, threshold) & (F.call_function("levenshtein", a, b, bound) >= 0)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def _tokens(text: Column, threshold: float) -> Column:
    """Character pairs of the text between end marks; single characters for low thresholds."""
    if threshold <= 2 / 3:
        return F.when(text == "", F.array(F.lit(""))).otherwise(_characters(text))
    marked = F.concat(F.lit("\u0002"), text, F.lit("\u0003"))
    chars = _characters(marked)
    firsts = F.slice(chars, F.lit(1), F.size(chars) - 1)
    seconds = F.slice(chars, F.lit(2), F.size(chars) - 1)
    return F.zip_with(firsts, seconds, lambda a, b: F.concat(a, b))


def _needed_overlap(length: Column, threshold: float) -> Column:
    """Fewest tokens a text of this length shares with any text at or above the threshold.

    A partner has at least length * t / (2 - t) characters. Let c be the common subsequence of
    texts with n and m characters, so c >= t (n + m) / 2. They share c single characters. Of the
    n + 1 marked pairs of the first text each deletion spoils two and each insertion one, so at
    least 3c - n - m + 1 are shared.
    """
    partner = F.ceil(length * F.lit(threshold / (2 - threshold)) - F.lit(EPSILON))
    total = length + partner
    if threshold <= 2 / 3:
        shared = F.lit(threshold / 2) * total
    else:
        shared = F.lit(1.5 * threshold - 1) * total + 1
    return F.greatest(F.ceil(shared - F.lit(EPSILON)), F.lit(1))


def text_signatures(vertices: DataFrame, threshold: float) -> DataFrame:
    """(id, block, length, signatures) such that two texts at or above the threshold share a signature.

    ``vertices`` holds id, block and text. Each text keeps its rarest tokens, just enough of them
    that sharing none rules the pair out (prefix filtering). Repeated tokens are numbered, so a
    text is a set. Signatures of different blocks never meet.
    """
    # Partitioned by id once: counting and regrouping per id below need no further shuffle.
    placed = vertices.select("id", "block", "text").repartition("id")
    tokens = (
        placed.select("id", F.explode(_tokens(F.col("text"), threshold)).alias("token"))
        .groupBy("id", "token")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("id", "token", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
    )
    frequency = stage(tokens.groupBy("token", "nth").agg(F.count(F.lit(1)).alias("freq")), "tokens")
    if frequency.count() <= BROADCAST_TOKENS:
        frequency = F.broadcast(frequency)
    ranked = (
        tokens.join(frequency, ["token", "nth"])
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "token", "nth"))).alias("tokens"))
    )
    size = F.size("tokens")
    kept = F.slice("tokens", F.lit(1), (size - _needed_overlap(F.length("text"), threshold) + 1).cast("int"))
    # Tokens that every text has bring together the same texts: one signature does for all.
    total = vertices.count()
    everywhere = F.xxhash64(F.col("block"), F.lit(""), F.lit(0))
    signature = F.transform(
        kept,
        lambda t: F.when(t["freq"] == total, everywhere).otherwise(F.xxhash64(F.col("block"), t["token"], t["nth"])),
    )
    return placed.join(ranked, "id").select("id", "block", F.length("text").alias("length"), signature.alias("signatures"))
