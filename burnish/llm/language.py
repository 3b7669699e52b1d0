"""Language identification by rank-order profiles of n-grams.

A profile lists the most frequent n-grams of 1 to LONGEST characters of a language by falling
frequency. A document gets a profile of its own and the language from whose profile its n-grams are
least out of place; an n-gram that a profile lacks counts as out of place by its whole length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.frames import map_batches

#: Ranks of a profile, longest n-gram, and the most labelled rows per language that profiles are learnt from.
RANKS, LONGEST, LEARN_ROWS = 300, 3, 1000
#: Characters whose n-grams are counted in one sort; a longer text is counted in parts.
PART = 1 << 20
_LETTER, _NOT_WORD = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")
#: Bits of a character in an n-gram's code.
_BITS = 21


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams and their counts. Words of letters are lower-cased and set off by a space."""
    words = " " + _NOT_WORD.sub(" ", text.lower()).strip() + " "
    found: list[tuple[np.ndarray, np.ndarray]] = []
    points = np.frombuffer(words.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    for start in range(0, len(points), PART):
        part, codes = points[start : start + PART + LONGEST - 1], []
        code = np.zeros(len(part), np.int64)
        for n in range(1, LONGEST + 1):
            code = (code[: len(part) - n + 1] << _BITS) | part[n - 1 :] if len(part) >= n else code[:0]
            own = code[: PART]
            # A space is part of an n-gram only at either end; one alone tells nothing.
            if n == 1:
                own = own[own != 32]
            elif n == 3:
                own = own[((own >> _BITS) & ((1 << _BITS) - 1)) != 32]
            codes.append(own)
        found.append(np.unique(np.concatenate(codes), return_counts=True))
    if len(found) == 1:
        return found[0]
    values, inverse = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate([c for _, c in found])).astype(np.int64)


def spelled(code: int) -> str:
    out = ""
    while code:
        out, code = chr(code & ((1 << _BITS) - 1)) + out, code >> _BITS
    return out


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS, rows: int = LEARN_ROWS) -> DataFrame:
    """``lang, gram, code, rank``: the ``ranks`` most frequent n-grams of each language (ties by code).

    Each language is learnt from at most ``rows`` of its rows, the ones whose texts hash lowest;
    copies of a text count once. Rows without text or language teach nothing. With up to 1,000 rows
    the limit is applied before the shuffle.
    """
    known = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body"))
    keyed = known.where("lang is not null and body is not null").select("lang", "body", F.xxhash64("body").alias("at"))
    lowest = keyed.select("lang", "at").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    lowest = lowest.withColumn("nth", nth).where(F.col("nth") <= rows).select("lang", "at")
    sample = keyed.join(F.broadcast(lowest), ["lang", "at"]).dropDuplicates(["lang", "at"])

    def count(batch: pa.RecordBatch) -> list:
        langs, codes, counts = [], [], []
        for name in pc.unique(batch.column(0)).to_pylist():
            own = batch.filter(pc.equal(batch.column(0), name)).column(1).to_pylist()
            parts = [grams(t) for t in own]
            values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            langs += [name] * len(values)
            codes.append(values)
            counts.append(np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64))
        return [langs, np.concatenate(codes or [np.empty(0, np.int64)]), np.concatenate(counts or [np.empty(0, np.int64)])]

    counted = map_batches(sample.select("lang", "body"), "lang string, code long, n long", count)
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < ranks).drop("n")


def identify(df: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, a row per input row.

    ``profiles`` (as from learn_profiles) is collected: languages x ranks lines. The score is one
    less the mean place by which an n-gram is out, as a share of the worst. Ties go to the language
    that sorts first. A null text, or one without a letter, is 'und' with score 0, as is every text
    when nothing was learnt. Repeated rows are judged alike; other columns are ignored.
    """
    lines = sorted((r["lang"], r["code"], r["rank"]) for r in profiles.select("lang", "code", "rank").collect())
    names = sorted({lang for lang, _, _ in lines})
    codes = np.unique(np.array([c for _, c, _ in lines], np.int64))
    worst = max([r for _, _, r in lines], default=-1) + 1
    # A last row stands for every n-gram that no profile has.
    place = np.full((len(codes) + 1, len(names)), -1, np.int64)
    for lang, code, rank in lines:
        place[np.searchsorted(codes, code), names.index(lang)] = rank

    def judge(body: str | None) -> tuple[str, float]:
        if not names or body is None or not _LETTER.search(body):
            return "und", 0.0
        values, counts = grams(body)
        top = values[np.lexsort((values, -counts))[:worst]]
        at = np.searchsorted(codes, top)
        at[(at == len(codes)) | (codes[np.minimum(at, len(codes) - 1)] != top)] = len(codes)
        ranks = place[at]
        out = np.where(ranks < 0, worst, np.abs(ranks - np.arange(len(top))[:, None])).mean(0)
        best = int(out.argmin())
        return names[best], float(1 - out[best] / worst)

    def columns_of(batch: pa.RecordBatch) -> list:
        judged = [judge(t) for t in batch.column(1).to_pylist()]
        return [batch.column(0), [name for name, _ in judged], [score for _, score in judged]]

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return map_batches(source, "doc_id long, lang_pred string, score double", columns_of)
