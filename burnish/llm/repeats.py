"""Removal of long repeated byte strings over the whole corpus, by suffix sorting of shards.

Shards are made so that equal strings meet. The smallest hash of the SAMPLE-byte strings within a
window of ``length`` bytes is the same wherever the window occurs; neighbouring windows that share
it form a run. Only runs whose hash occurs again can hold a repeat. Each distinct run goes once, with
how often it occurs, to the shard of its hash, and external induced sorting (suffixes.py) finds the
windows that two runs share. A hash with more than HOT distinct runs is no longer one shard's work:
its windows are counted one by one, summed before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.llm.frames import arrow_schema, map_batches, utf8
from burnish.llm.suffixes import repeated_starts

LENGTH, SAMPLE, HOT = 200, 32, 50_000
#: Bytes of a text that are hashed at once (parts overlap by a window), and of a shard that is sorted at once.
PART, SHARD = 1 << 20, 1 << 21

_RUN = "digest binary, start long, n int, meet long, run long"
#: One stretch from 0 to n, written as _spans does: the hexadecimal bytes of n from the last.
WHOLE = "unhex(concat('00000000', regexp_replace(lpad(hex(n), 8, '0'), '(..)(..)(..)(..)', '$4$3$2$1')))"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def _doubled(h: np.ndarray, by: int) -> np.ndarray:
    """From hashes of strings those of strings ``by`` places longer than where the second one starts."""
    return _mixed(h[:-by] * _ODD[1] + h[by:] * _ODD[2])


def _spans_of(raw: np.ndarray, length: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of ``sample`` bytes and of ``length`` bytes."""
    h, size = _mixed(raw.astype(np.uint64) + np.uint64(1)), 1
    samples = None
    while size < length:
        by = min(size, sample - size if size < sample else length - size)
        h, size = _doubled(h, by), size + by
        if size == sample:
            samples = h
    return samples, h


def _runs(raw: np.ndarray, length: int, sample: int) -> tuple[np.ndarray, ...]:
    """start, n, meet, run of each run of window starts: the hash they share, and a hash of the run's bytes."""
    samples, whole = _spans_of(raw, length, sample)
    # The place is in the low bits: of equal hashes the leftmost counts.
    low = np.uint64((1 << 24) - 1)
    least, size, window = (samples & ~low) | np.arange(len(samples), dtype=np.uint64), 1, length - sample + 1
    while size < window:
        by = min(size, window - size)
        least, size = np.minimum(least[:-by], least[by:]), size + by
    anchor = (least & low).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    n = np.diff(np.append(starts, len(anchor)))
    ends = starts + n - 1
    middle = np.minimum(starts + length // 2, ends)
    run = _mixed(whole[starts] * _ODD[0] + _mixed(whole[middle] * _ODD[1] + whole[ends]) + n.astype(np.uint64))
    return starts, n, samples[anchor[starts]].view(np.int64), run.view(np.int64)


def _all_runs(body: bytes, length: int, sample: int) -> Iterator[tuple[np.ndarray, ...]]:
    raw = np.frombuffer(body, np.uint8)
    for at in range(0, max(0, len(raw) - length + 1), PART):
        starts, *rest = _runs(raw[at : at + PART + length - 1], length, sample)
        yield starts + at, *rest


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _corpus(df: DataFrame, key: str, text: str) -> DataFrame:
    return utf8(df.withColumn(key, F.col(key).cast("long")), text, F.col(key).alias("doc_id"))


def _run_rows(corpus: DataFrame, length: int, sample: int) -> DataFrame:
    def columns_of(batch: pa.RecordBatch) -> list:
        parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        digests = []
        for body in batch.column(0).to_pylist():
            own = _digest(body)
            for found in _all_runs(body, length, sample):
                for part, values in zip(parts, found):
                    part.append(values)
                digests += [own] * len(found[0])
        start, n, meet, run = map(np.concatenate, parts)
        return [digests, start, n.astype(np.int32), meet, run]

    return map_batches(corpus.where(F.length("body") >= length).select("body"), _RUN, columns_of)


def _packed(corpus: DataFrame) -> DataFrame:
    """doc_id, digest, and the text compressed, for shuffles."""

    def columns_of(batch: pa.RecordBatch) -> list:
        bodies, press = batch.column(1).to_pylist(), zstandard.ZstdCompressor(1)
        return [batch.column(0), [_digest(b) for b in bodies], [press.compress(b) for b in bodies]]

    return map_batches(corpus, "doc_id long, digest binary, packed binary", columns_of)


def _spans(marks: np.ndarray) -> bytes:
    """Begins and ends of the stretches of true values, as little-endian 32-bit integers."""
    return np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))).astype("<i4").tobytes()


def _sorted_shards(runs: DataFrame, length: int) -> DataFrame:
    """meet, run, n, spans: the stretches of window starts that repeat, of runs (meet, run, n, times, body)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        marks = repeated_starts([body for *_, body in rows], length)
        out, at = [], 0
        for _, _, n, times, body in rows:
            out.append(_spans(marks[at : at + n] | (times > 1)))
            at += len(body)
        meet, run, n, _, _ = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((meet, run, n, out), schema)], schema=schema)

    schema = arrow_schema("meet long, run long, n int, spans binary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``meet``; a shard ends between two of its values."""
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = row[0]
        if held:
            yield solve(held)

    ordered = runs.repartition("meet").sortWithinPartitions("meet", "run").select("meet", "run", "n", "times", "body")
    return ordered.mapInArrow(shards, "meet long, run long, n int, spans binary")


def _counted_windows(runs: DataFrame, length: int) -> DataFrame:
    """The same for hashes with very many runs: every window is counted under a 128-bit hash."""

    def windows(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], [], [], []]
        for meet, run, n, times, body in zip(*(c.to_pylist() for c in batch.columns)):
            for at in range(n):
                for column, value in zip(out, (meet, run, n, at, _digest(body[at : at + length]), times)):
                    column.append(value)
        return out

    each = map_batches(runs.select("meet", "run", "n", "times", "body"), "meet long, run long, n int, at int, window binary, times long", windows)
    counts = each.groupBy("window").agg(F.sum("times").alias("all")).where(F.col("all") > 1)
    again = each.join(counts, "window", "left_semi").groupBy("meet", "run", "n").agg(F.collect_list("at").alias("at"))

    def spans(batch: pa.RecordBatch) -> list:
        found = []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            marks = np.zeros(n, bool)
            marks[at] = True
            found.append(_spans(marks))
        return [*batch.columns[:3], found]

    return map_batches(again, "meet long, run long, n int, spans binary", spans)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, spans``, a row per input row.

    A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else, in
    the same text too; ``spans`` lists begins and ends of what goes as 32-bit integers, ``kept`` is
    what stays. Null texts count as empty. Rows that repeat a text of ``length`` bytes or more lose
    all of it, whatever their keys. Other columns are ignored; an empty table gives an empty result.
    """
    corpus = _corpus(df, key, text)
    sample = min(SAMPLE, length)
    runs = stage(_run_rows(corpus, length, sample), "runs")
    meeting = runs.groupBy("meet").agg(F.count("*").alias("c")).where("c > 1").select("meet")
    suspects = stage(runs.join(meeting, "meet", "left_semi"), "suspects")
    copies = corpus.select("body").where(F.length("body") >= length)
    copies = map_batches(copies, "digest binary", lambda b: [[_digest(x) for x in b.column(0).to_pylist()]])
    copies = stage(copies.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest"), "copies")

    distinct = suspects.groupBy("meet", "run", "n").agg(F.count("*").alias("times"), F.min(F.struct("digest", "start")).alias("at"))
    distinct = stage(distinct.select("meet", "run", "n", "times", "at.digest", "at.start"), "distinct")
    # A hash with one run has nothing to sort: all of the run repeats if the run does.
    groups = distinct.groupBy("meet").agg(F.count("*").alias("c"))
    mixed = stage(distinct.join(groups.where("c > 1").select("meet", (F.col("c") > hot).alias("hot")), "meet"), "mixed")
    plain = distinct.join(groups.where("c = 1").select("meet"), "meet", "left_semi").where("times > 1")
    wanted = mixed.groupBy("digest").agg(F.collect_list(F.struct("meet", "run", "n", "times", "hot", "start")).alias("wanted"))
    one_each = _packed(corpus.where(F.length("body") >= length)).groupBy("digest").agg(F.first("packed").alias("packed"))
    unique = one_each.join(wanted, "digest")

    def cut(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], [], [], []]
        unpress = zstandard.ZstdDecompressor()
        for packed, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = unpress.decompress(packed)
            for r in rows:
                for column, value in zip(out, (r["meet"], r["run"], r["n"], r["times"], r["hot"], body[r["start"] : r["start"] + r["n"] + length - 1])):
                    column.append(value)
        return out

    bodies = map_batches(unique.select("packed", "wanted"), "meet long, run long, n int, times long, hot boolean, body binary", cut)
    bodies = stage(bodies, "bodies")
    found = _sorted_shards(bodies.where("not hot").drop("hot"), length)
    if not bodies.where("hot").isEmpty():
        found = found.unionByName(_counted_windows(bodies.where("hot").drop("hot"), length))
    found = found.unionByName(plain.select("meet", "run", "n", F.expr(WHOLE).alias("spans")))
    found = stage(found.where(F.length("spans") > 0), "found")

    single = suspects.join(copies, "digest", "left_anti").join(found, ["meet", "run", "n"])
    removed = single.groupBy("digest").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    removed = removed.unionByName(copies.select("digest", F.lit(None).cast(removed.schema["found"].dataType).alias("found")).withColumn("all", F.lit(True)), allowMissingColumns=True)

    def result(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], [], []]
        unpress = zstandard.ZstdDecompressor()
        for packed, rows, whole in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            body = unpress.decompress(packed)
            gone = np.zeros(len(body) + 1, np.int32)
            if whole:
                gone[[0, len(body)]] = 1, -1
            for r in rows or ():
                edges = np.frombuffer(r["spans"], "<i4").reshape(-1, 2) + r["start"]
                np.add.at(gone, edges[:, 0], 1)
                np.add.at(gone, edges[:, 1] - 1 + length, -1)
            covered = np.cumsum(gone)[:-1] > 0
            spans = _spans(covered)
            for column, value in zip(out, (len(body), int(covered.sum()), len(spans) // 8, np.frombuffer(body, np.uint8)[~covered].tobytes(), spans)):
                column.append(value)
        return [batch.column(0), *out]

    rows = _packed(corpus).join(removed, "digest", "left").select("doc_id", "packed", "found", "all")
    return map_batches(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans binary", result)
