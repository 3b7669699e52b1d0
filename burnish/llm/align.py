"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Each tokenizer's own spans give coarse cuts: character offsets of the byte-level one, byte spans of
the piece one. Where a span falls inside a character (a character of several byte tokens, byte
fallback) the cut is refined by the lengths of the decoded bytes. Offsets where both have a cut
part a text into groups; the tokens that end there are a link.

Neither tokenizer joins across a single space between two other signs, so a text is aligned by the
chunks between such spaces, and a chunk met before is looked up. A vocabulary with pieces that cross
a space has its texts aligned whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burnish.functions.scratch import stage
from burnish.llm.bpe import byte_signs
from burnish.llm.frames import arrow_schema

#: Chunks remembered by a task since it last forgot, their longest, rows of a slice, pairs gathered before they are handed on.
CACHED, LONGEST, SLICE, GATHERED = 150_000, 48, 256, 1 << 20
#: Signs that are read side by side: both tokenizers take half as long again on texts too long for a core's cache.
READ = 1 << 11
#: Link counts sent to every task: 17 bytes each. More are joined.
SENT = 2_000_000
SPACE_SIGN = "▁"
#: A single space with other signs around it. (U+180E is a space to some versions of Unicode.)
_BORDER = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
_EDGE = re.compile("^[\\s᠎]|[\\s᠎]$")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary"
_PAIR = "code long, links long"


class _Spelled(dict):
    """The spelling of a group of one token each, by code: no more than the vocabularies have tokens of the same bytes."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, code: int) -> str:
        self[code] = value = f"{code // self.width}|{code % self.width}"
        return value


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {sign: bytes([i]) for i, sign in enumerate(byte_signs())}
        with open(a_path, encoding="utf-8") as f:
            added = {t["id"]: t["content"] for t in json.load(f)["added_tokens"]}
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = i not in added and all(c in byte_of for c in token)
            self.a_bytes[i] = b"".join(byte_of[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(SPACE_SIGN, " ").encode() for p in pieces
        ]
        self.crosses = any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        self.width = len(pieces)
        self.said = [str(i) for i in range(max(self.width, max(self.a_bytes) + 1))]
        self.spelled = _Spelled(self.width)

    def chunks(self, texts: list[str], known: dict) -> tuple[list[list[str]], set[str]]:
        """Each text without its leading space, in chunks to be read after a space; and the chunks that are empty or have white space at an end.

        A text none of whose parts between spaces is such a chunk is cut at every space. ``known`` holds no such chunk.
        """
        if self.crosses:
            return [[t] if t else [] for t in texts], set()
        parts = [t.split(" ") if t else [] for t in texts]
        edged = {c for c in set().union(*parts).difference(known) if not c or _EDGE.search(c)}
        found = set()
        for i in [i for i, p in enumerate(parts) if edged and not edged.isdisjoint(p)]:
            parts[i] = _BORDER.split(texts[i])
            found.update(c for c in parts[i] if not c or _EDGE.search(c))
        return parts, found

    def align(self, chunks: list[str]) -> list[tuple | None]:
        """Of each chunk the numbers of tokens, the groups spelled out and the linked pairs; None where bytes differ.

        Chunks without white space at their ends are read side by side, with the spaces between them
        that they were cut at.
        """
        out: list[tuple | None] = [None] * len(chunks)
        plain = [] if self.crosses else [i for i, c in enumerate(chunks) if c and not _EDGE.search(c)]
        single = set(range(len(chunks))) - set(plain)
        parts, length = [[]], 0
        for i in plain:
            if length > READ:
                parts.append([])
                length = 0
            parts[-1].append(i)
            length += len(chunks[i])
        for part in [*parts, *([i] for i in single)]:
            for i, got in zip(part, self._side_by_side([chunks[i] for i in part]) if part else ()):
                out[i] = got
        return out

    def _side_by_side(self, chunks: list[str]) -> list[tuple | None]:
        text = " ".join(chunks)
        codes = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])
        coded = self.a.encode_batch([" " + text], add_special_tokens=False)[0]
        pieces = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        a, b = np.array(coded.ids, np.int64), np.array(pieces["ids"], np.int64)
        data = b" " + text.encode()
        # Character offsets to byte offsets; spans of the pieces leave out the space that is added.
        a_cuts = refined(at[[end for _, end in coded.offsets]], self.a_bytes, a, data)
        b_cuts = refined(np.array([end for _, end in pieces["offsets"]], np.int64) + 1, self.b_bytes, b, data)
        if a_cuts is None or b_cuts is None:
            if len(chunks) == 1:
                return [None]
            half = len(chunks) // 2
            return self._side_by_side(chunks[:half]) + self._side_by_side(chunks[half:])
        common, a_end, b_end = np.intersect1d(a_cuts, b_cuts, assume_unique=True, return_indices=True)
        linked = (a[a_end] * self.width + b[b_end]).astype("<i8")
        a_from, b_from = np.concatenate([[0], a_end + 1]), np.concatenate([[0], b_end + 1])
        many = np.flatnonzero((np.diff(a_from) > 1) | (np.diff(b_from) > 1))
        single = np.ones(len(linked), bool)
        single[many] = False
        groups = np.empty(len(linked), object)
        groups[single] = [self.spelled[c] for c in linked[single].tolist()]
        a_said, b_said = [self.said[i] for i in a.tolist()], [self.said[i] for i in b.tolist()]
        spans = (a_from[many], a_from[many + 1], b_from[many], b_from[many + 1])
        groups[many] = [f"{','.join(a_said[i:p])}|{','.join(b_said[j:q])}" for i, p, j, q in zip(*(at.tolist() for at in spans))]
        groups, packed = groups.tolist(), linked.tobytes()
        # A chunk ends before the space of the next one.
        ends = at[np.cumsum([len(c) + 1 for c in chunks])]
        starts = np.concatenate([[0], ends[:-1]])
        spans = [np.searchsorted(cuts, (starts, ends), "right").tolist() for cuts in (a_cuts, b_cuts, common)]
        return [
            (a1 - a0, b1 - b0, ";".join(groups[g0:g1]), packed[8 * g0 : 8 * g1])
            for a0, a1, b0, b1, g0, g1 in zip(*(side for span in spans for side in span))
        ]


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str, *written: int) -> Pair:
    """What a process has read of two files as they were ``written``: its next task need not read them again."""
    return Pair(a_path, b_path)


def refined(coarse: np.ndarray, token_bytes, ids: np.ndarray, data: bytes) -> np.ndarray | None:
    """The byte offsets where tokens end, from coarse ones. None if the tokens do not spell ``data``.

    A coarse cut is right where the tokens before it have as many bytes. Those inside a character,
    of tokens that share it, come from the last right cut and the decoded bytes since.
    """
    tokens = [token_bytes[i] for i in ids.tolist()]
    if b"".join(tokens) != data or not tokens:
        return None
    whole = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    right = coarse == whole
    last = np.maximum.accumulate(np.where(right, np.arange(len(ids)), -1))
    base = np.where(last >= 0, coarse[last] - whole[last], 0)
    return np.where(right, coarse, base + whole)


def align(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, n_links, groups, codes``, a row per input row.

    ``a_path`` is a byte-level tokenizer file, ``b_path`` a piece model; every executor can open
    both. Special strings in a text are plain text. ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``codes``
    holds a number per link, A id times the size of B's vocabulary plus B id, little-endian 64-bit.
    ``row`` numbers the rows of this frame: write it before it is read twice. Texts that are null,
    empty, or that a tokenizer does not give back byte by byte have no tokens. Repeated rows and
    null keys are kept; other columns are ignored whatever their names; an empty table gives an
    empty result.
    """
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    schema = arrow_schema(_ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is remembered holds no cycles: looking for them among its many tuples would cost an eighth of the time.
        often = gc.get_threshold()
        gc.set_threshold(1_000_000, *often[1:])
        try:
            yield from aligned(batches)
        finally:
            gc.set_threshold(*often)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = [os.stat(path).st_mtime_ns for path in (a_path, b_path)]
        pair, known, older, row = _pair(a_path, b_path, *written), {}, {}, TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts, edged = pair.chunks(part.column(1).to_pylist(), known)
                if len(known) > CACHED:
                    # What was not met since the last time is forgotten.
                    known, older = {}, known
                unknown = set().union(*texts).difference(known)
                known.update((c, older[c]) for c in unknown if c in older)
                new = list(unknown.difference(older))
                known.update(zip(new, pair.align(new)))
                out = []
                for chunks in texts:
                    got = list(map(known.__getitem__, chunks))
                    if not got or None in got:
                        out.append((0, 0, 0, 0, "", b""))
                        continue
                    n_a, n_b, groups, codes = zip(*got)
                    codes = b"".join(codes)
                    n_links = len(codes) // 8  # one a group
                    out.append((sum(n_a), sum(n_b), n_links, n_links, ";".join(groups), codes))
                for c in edged.union(c for c in new if len(c) > LONGEST):
                    del known[c]
                rows = range(row, row := row + part.num_rows)
                columns = [list(rows), part.column(0), *zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return source.mapInArrow(run, _ALIGNED)


def link_counts(aligned: DataFrame, codes: str = "codes") -> DataFrame:
    """``code, links``: how many links of all texts hold each pair linked, summed in tasks before they are shuffled."""
    schema = arrow_schema(_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                new = np.frombuffer(b"".join(batch.column(0).slice(start, SLICE).to_pylist()), "<i8")
                new, n = np.unique(new, return_counts=True)
                merged, place = np.unique(np.concatenate([held, new]), return_inverse=True)
                total = np.zeros(len(merged), np.int64)
                np.add.at(total, place, np.concatenate([sums, n]))
                held, sums = merged, total
                if len(held) > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)
                    held, sums = held[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)

    return aligned.select(codes).mapInArrow(run, _PAIR).groupBy("code").agg(F.sum("links").alias("links"))


def with_best(counts: DataFrame, width: int) -> DataFrame:
    """``code, a, b, links, best``: best where no other A id is linked with the B id more often."""
    pairs = counts.select("code", F.expr(f"code div {width}").alias("a"), (F.col("code") % width).alias("b"), "links")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("code", "a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, links: DataFrame, sent: int = SENT) -> DataFrame:
    """``aligned`` with ``n_best, count_sum`` in place of ``codes``.

    Up to ``sent`` pairs are sent to the tasks. More are joined with the distinct pairs of each row.
    Both give the same rows.
    """
    names = ["n_best", "count_sum"]
    if links.count() <= sent:
        table = links.select("code", "links", "best").toArrow().sort_by("code")
        shared = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "links", "best")))
        kept = [f for f in aligned.schema.fields if f.name != "codes"]
        schema = StructType([*kept, *StructType.fromDDL("n_best long, count_sum long").fields])

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, count, best = shared.value
            for batch in batches:
                sums = []
                for packed in batch.column("codes").to_pylist():
                    at = np.searchsorted(code, np.frombuffer(packed, "<i8"))
                    sums.append((int(best[at].sum()), int(count[at].sum())))
                columns = [*(batch.column(f.name) for f in kept), *(pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ((), ())))]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *names])

        return aligned.mapInArrow(look_up, schema)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for row, packed in zip(*(c.to_pylist() for c in part.columns)):
                    code, times = np.unique(np.frombuffer(packed, "<i8"), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), pa.array(code), pa.array(times)], ["row", "code", "times"])

    pairs = aligned.where("n_links > 0").select("row", "codes").mapInArrow(spelled, "row long, code long, times long").join(links, "code")
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    sums = pairs.groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    joined = aligned.drop("codes").join(sums, "row", "left")
    return joined.select(*(c for c in aligned.columns if c != "codes"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))


def alignment_report(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row per input row. See align()."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    counts = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")
    aligned = stage(align(df, a_path, b_path, key, text).select(*counts, digest, "codes"), "aligned")
    links = stage(with_best(link_counts(aligned), piece_count(b_path)), "links")
    return score_links(aligned, links, sent).select(*counts[1:], "n_best", "count_sum", "groups_sha256")


def piece_count(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
