"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Only compressed 64-bit fingerprints travel at first. Each sender sorts those of a block of rows,
cuts them by owner (their leading bits) and codes the differences with Golomb-Rice codes. An owner
answers each message with a bitmap of the fingerprints that it has seen twice. Rows under a marked
fingerprint are suspects, and only their texts are shuffled, to be compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.llm.frames import SPACES, arrow_schema, map_batches, utf8

#: Fingerprints a sender codes at once, and about how many an owner decodes at once.
BLOCK, OWNED = 1 << 17, 1 << 17
#: log2 of the bits of the filter that keeps texts of clear rows out of the shuffle: 2 MB, whatever the input.
FILTER_BITS = 24

_MESSAGE = "owner long, sender long, block long, n long, low long, again binary, quotients binary, remainders binary"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 values as (bits of a remainder, unary quotients, remainders)."""
    gaps = np.diff(values, prepend=np.uint64(0))
    low = max(0, int(gaps[1:].mean()).bit_length() - 1) if len(gaps) > 1 else 63
    low = max(low, int(gaps[0]).bit_length() - 12, 0)  # the first value counts from 0
    shift = np.uint64(low)
    ends = np.cumsum((gaps >> shift).astype(np.int64) + 1)
    unary = np.zeros(ends[-1], np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    return low, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(n: int, low: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    rest = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * low).reshape(n, low)
    weights = np.uint64(1) << np.arange(low, dtype=np.uint64)
    return np.cumsum(high + (rest * weights).sum(1, dtype=np.uint64), dtype=np.uint64)


def _messages(prints: DataFrame, owner_bits: int) -> DataFrame:
    """One row per (block of rows, owner): its distinct fingerprints less the owner's bits, coded."""
    schema = arrow_schema(_MESSAGE)

    def coded(block: np.ndarray, number: int) -> pa.RecordBatch:
        values, counts = np.unique(block, return_counts=True)
        owners = values >> np.uint64(64 - owner_bits)
        sender, rows = TaskContext.get().partitionId(), []
        for at in np.split(np.arange(len(values)), np.flatnonzero(np.diff(owners)) + 1):
            own = values[at] & np.uint64((1 << (64 - owner_bits)) - 1)
            low, quotients, remainders = golomb_encode(own)
            again = np.packbits(counts[at] > 1).tobytes()
            rows.append((int(owners[at[0]]), sender, number, len(at), low, again, quotients, remainders))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= BLOCK:
                yield coded(np.concatenate(held), number)
                held, size, number = [], 0, number + 1
        if size:
            yield coded(np.concatenate(held), number)

    return prints.mapInArrow(run, _MESSAGE)


def _bitmaps(messages: DataFrame) -> DataFrame:
    """The owners' answers: for each message the bits of its fingerprints that occur again."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [golomb_decode(r["n"], r["low"], r["quotients"], r["remainders"]) for r in rows]
        own = [np.unpackbits(np.frombuffer(r["again"], np.uint8), count=r["n"]) for r in rows]
        values, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        marked = counts > 1
        np.logical_or.at(marked, inverse, np.concatenate(own).astype(bool))
        bits = np.split(marked[inverse], np.cumsum([len(p) for p in parts])[:-1])
        packed = [np.packbits(b).tobytes() for b in bits]
        return table.select(["owner", "sender", "block"]).append_column("bits", pa.array(packed, pa.binary()))

    return messages.groupBy("owner").applyInArrow(answer, "owner long, sender long, block long, bits binary")


def _suspects(messages: DataFrame, bitmaps: DataFrame, owner_bits: int) -> DataFrame:
    """Distinct fingerprints that the bitmaps mark."""

    def decode(batch: pa.RecordBatch) -> list:
        out = [np.empty(0, np.uint64)]
        for r in batch.to_pylist():
            values = golomb_decode(r["n"], r["low"], r["quotients"], r["remainders"])
            hit = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
            out.append(values[hit] | (np.uint64(r["owner"]) << np.uint64(64 - owner_bits)))
        return [np.concatenate(out).view(np.int64)]

    return map_batches(messages.join(bitmaps, ["owner", "sender", "block"]), "print long", decode).distinct()


def _digest(df: DataFrame, key: str, text: str, with_body: bool) -> DataFrame:
    """key, n_points, sha, print (its first 8 bytes); with_body: the text without white space too."""

    def columns_of(batch: pa.RecordBatch) -> list:
        bodies = [b.translate(None, SPACES) for b in batch.column(2).to_pylist()]
        shas = [hashlib.sha256(b).digest() for b in bodies]
        prints = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64).view(np.int64)
        return [batch.column(0), batch.column(1), shas, prints, *[bodies] * with_body]

    points = F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_points")
    source = utf8(df.select(F.col(key).cast("long").alias("doc_id"), points, F.col(text).alias("t")), "t", "doc_id", "n_points")
    return map_batches(source, "doc_id long, n_points long, sha binary, print long" + ", body binary" * with_body, columns_of)


#: Where a fingerprint stands in the filter: a word of 64 bits, and a bit of it.
_WORD, _BIT = f"shiftrightunsigned(print, {70 - FILTER_BITS})", f"cast(shiftrightunsigned(print, {64 - FILTER_BITS}) % 64 as int)"


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of texts that are identical without the characters [\\x20\\x09-\\x0D].

    Returns doc_id, keep_id, group_size, kept, text_sha256, a row per input row. The row with the
    most code points stays, then the smallest key (a null key comes last). A null text counts as
    empty, and empty texts form a group like any other. Of rows that repeat a key and a text, one is
    kept. Other columns are ignored, whatever their names; an empty table gives an empty result.

    Nothing is collected. The filter made of suspect fingerprints has 2 ** FILTER_BITS bits, a bound
    that does not depend on the input; when it fills up, more texts are shuffled and nothing is lost.
    """
    rows = stage(_digest(df, key, text, with_body=False), "prints")
    owner_bits = max(4, (rows.count() // OWNED).bit_length())
    messages = stage(_messages(rows.select("print"), owner_bits), "messages")
    suspects = stage(_suspects(messages, _bitmaps(messages), owner_bits), "suspects")

    filter_words = suspects.groupBy(F.expr(_WORD).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {_BIT}))").alias("bits"))
    texts = _digest(df, key, text, with_body=True).withColumn("word", F.expr(_WORD))
    texts = texts.join(F.broadcast(filter_words), "word").where(f"getbit(bits, {_BIT}) = 1")
    # Equal bytes meet as a grouping key; counts are summed before the shuffle.
    verified = texts.groupBy("sha", "body").agg(F.count("*").alias("group_size")).where("group_size > 1").drop("body")

    marked = rows.join(suspects.withColumn("marked", F.lit(True)), "print", "left").drop("print")
    alone, maybe = marked.where("marked is null").drop("marked"), marked.where("marked").drop("marked")
    repeats = maybe.groupBy("doc_id", "sha", "n_points").agg(F.count("*").alias("times"))
    order = F.struct("n_points", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    stays = repeats.groupBy("sha").agg(F.max_by(F.struct("doc_id", "n_points"), order).alias("stay"))
    # Written first, so that both sides of the join below are plain shuffles and a hot text can be split.
    groups = stage(stays.join(verified, "sha", "left"), "groups")
    grouped = (
        repeats.join(groups, "sha")
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select(
            "doc_id",
            F.col("stay.doc_id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("n_points") == F.col("stay.n_points")) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return single.unionByName(grouped)
