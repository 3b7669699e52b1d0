"""BPE encoding and decoding, with tree concatenation for long unsplit text.

White space always separates tokens, so texts are encoded by their white-space-free chunks, which
repeat; a chunk is cut into units (runs of letters, single digits, runs of other signs, clitics).
A unit of up to LEAF symbols is merged directly. A longer one is halved; both halves are encoded,
and a window around the join, growing on both sides, is encoded anew until its outermost tokens are
those the halves had there. Tokens that are right in each adjacent pair are the encoding of the
whole, so agreement on both sides makes the joined list exact.

Letters, digits and case follow the installed ``regex`` and Python; code points newer than Unicode 15
may fall in another class than in the tokenizer.

Texts of over ``spread`` code points are cut into rows first, halves of long units among them, so
that tasks encode them in parallel; the same joining then runs up the tree over the rows.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from burnish.functions.scratch import stage
from burnish.llm.frames import arrow_schema

LEAF, SPREAD, CACHED = 48, 1 << 20, 1 << 17
#: Rows that a task holds as Python texts.
SLICE = 256
#: Above every merge's rank.
NEVER = 1 << 60
#: White space to the tokenizer: the Unicode property, which lacks four controls that str.split() splits at.
_SPACE, _ODD_SPACE = regex.compile(r"\p{White_Space}+"), regex.compile(r"[\x1c-\x1f]")


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: merges, unit pattern, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.unit = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        signs = byte_signs()
        self.inner = [self.ids.get(c) for c in signs]
        self.final = [self.ids.get(c + self.suffix) for c in signs]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in (self.ids | self.special).items()}

    @cached_property
    def base(self) -> dict[int, list[int]]:
        """The symbols of each token; read where neighbours are joined."""
        return {i: self._symbols_of(t) for t, i in self.ids.items()}

    def decode(self, packed: bytes | None) -> str:
        """The tokens of little-endian 32-bit ids, a space between; ids out of the vocabulary are left out."""
        tokens = self.tokens
        return " ".join([t for i in np.frombuffer(packed or b"", "<u4").tolist() if (t := tokens.get(i)) is not None])

    def _symbols_of(self, token: str) -> list[int]:
        body = token.removesuffix(self.suffix) if self.suffix else token
        if body == token:
            return [self.ids[c] for c in body if c in self.ids]
        return [self.ids[c] for c in body[:-1] if c in self.ids] + [self.ids[c] for c in [body[-1:] + self.suffix] if c in self.ids]


def merge(symbols: list[int], v: Vocabulary) -> list[int]:
    """Applies the best-ranked merge, leftmost first, until none is left."""
    if len(symbols) > LEAF:
        return _merge_many(symbols, v)
    symbols, rank_of, made = list(symbols), v.merges.get, v.made
    ranks = [rank_of(p, NEVER) for p in zip(symbols, symbols[1:])]
    while ranks and (best := min(ranks)) < NEVER:
        i = ranks.index(best)
        symbols[i : i + 2] = (made[best],)
        del ranks[i]
        if i:
            ranks[i - 1] = rank_of((symbols[i - 1], symbols[i]), NEVER)
        if i < len(ranks):
            ranks[i] = rank_of((symbols[i], symbols[i + 1]), NEVER)
    return symbols


def _merge_many(symbols: list[int], v: Vocabulary) -> list[int]:
    """The same with a heap, for windows that had to grow."""
    n, merges = len(symbols), v.merges
    tokens, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if tokens[i] != left or j >= n or tokens[j] != right:
            continue
        tokens[i], tokens[j], after[i] = v.made[rank], -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (rank := merges.get((tokens[a], tokens[b]))) is not None:
                heapq.heappush(heap, (rank, a, tokens[a], tokens[b]))
    return [t for t in tokens if t >= 0]


class Encoder:
    """Encodes texts; keeps the chunks met so far, up to CACHED of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chunks: dict[str, bytes] = {}

    def symbols(self, unit: str, ends: bool = True) -> list[int]:
        """The unit's bytes as ids; the last one marks the end of the word if the unit ends here."""
        data = unit.encode()
        out = [self.v.inner[b] for b in data[: len(data) - ends]] + [self.v.final[b] for b in data[len(data) - ends :]]
        return [s for s in out if s is not None]

    def encode(self, symbols: list[int]) -> list[int]:
        """One unit's ids: directly, or by both halves and their join."""
        if len(symbols) <= LEAF:
            return merge(symbols, self.v)
        half = len(symbols) // 2
        return self.join(self.encode(symbols[:half]), self.encode(symbols[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded neighbours."""
        size = 2
        while True:
            a, b = left[-size:], right[:size]
            window = merge([s for t in a + b for s in self.v.base[t]], self.v)
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            size *= 2

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) for a special string, (None, chunks) for what is between. Special strings are those of the text as given."""
        pattern = self.v.special_pattern
        for part in pattern.split(text) if pattern and any(t in text for t in self.v.special) else [text]:
            if (found := self.v.special.get(part)) is not None:
                yield found, []
                continue
            odd = _ODD_SPACE.search(part)
            if not part.isascii():
                # Each letter is lowered by itself: there is no final form of sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            yield None, [c for c in _SPACE.split(part) if c] if odd else part.split()

    def text(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        ids, known = [], self.chunks
        for special, chunks in self.segments(text):
            if special is not None:
                ids.append(_packed([special]))
            for c in chunks:
                got = known.get(c)
                if got is None:
                    if len(known) >= CACHED:
                        known.clear()
                    got = _packed([i for u in self.v.unit.findall(c) for i in self.encode(self.symbols(u))])
                    if len(c) <= LEAF:
                        known[c] = got
                ids.append(got)
        return b"".join(ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """``doc_id, n_tokens, ids``, a row per input row; ids are little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a tokenizer file (byte-level BPE with word ends) that every
    executor can open. A null text counts as empty and has no tokens. Repeated rows and null keys
    are kept as they are; other columns are ignored whatever their names; an empty table gives an
    empty result. Texts over ``spread`` code points are encoded in pieces by many tasks.
    """
    ids = _coded(df, vocabulary, key, text, spread, "ids binary", lambda v, ids: [ids])
    return ids.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), "ids")


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: encode() and decode() of its ids by the same task. Input as in encode()."""
    out = _coded(df, vocabulary, key, text, spread, "ids binary, decoded string", lambda v, ids: [ids, v.decode(ids)])
    return out.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), "ids", "decoded")


def _coded(df: DataFrame, vocabulary: str, key: str, text: str, spread: int, ddl: str, columns_of: Callable[[Vocabulary, bytes], list]) -> DataFrame:
    """``doc_id`` and the columns ``ddl`` that are made of the ids, for short texts where they are encoded."""
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    ddl = f"doc_id long, {ddl}"
    schema = arrow_schema(ddl)

    def filled(v: Vocabulary, keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        columns = list(zip(*(columns_of(v, i) for i in ids))) or [()] * (len(schema) - 1)
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield filled(encoder.v, part.column(0), [encoder.text(t) for t in part.column(1).to_pylist()])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        for batch in batches:
            for start in range(batch.num_rows):
                part = batch.slice(start, 1)
                yield filled(v, part.column(0), part.column(1).to_pylist())

    long = F.length("body") > spread
    out = source.where(~long).mapInArrow(run, ddl)
    # Workers for pieces are only started where a text needs them.
    if source.where(long).limit(1).isEmpty():
        return out
    return out.unionByName(_encode_pieces(source.where(long), vocabulary, spread).mapInArrow(finish, ddl))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The frame with a column ``into``: the tokens with a space between, special ones included.

    Ids out of the vocabulary are left out; null decodes to an empty text. A column that is already
    named ``into`` is replaced.
    """
    source = df.drop(into)
    schema = StructType([*source.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [v.decode(packed) for packed in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, into])

    return source.mapInArrow(run, schema)


# -- very long texts ----------------------------------------------------------------------------

_PIECE = "row long, doc_id long, at long, part long, ends boolean, special long, body string"
_CODED = "row long, doc_id long, at long, part long, ids binary"


def _encode_pieces(df: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """``doc_id, ids`` of long texts. Pieces of about ``size`` code points are encoded by any task.

    A piece holds whole units, a special string, or one of the parts of a long unit. Cutting reads a
    text once and merges nothing. The pieces of a text are then put together in one task: those of
    a long unit are joined two by two up the tree.
    """

    piece_schema, coded_schema = arrow_schema(_PIECE), arrow_schema(_CODED)

    def cut(row: int, doc_id: int, text: str, encoder: Encoder) -> Iterator[tuple]:
        at, held, length = 0, [], 0
        for special, chunks in encoder.segments(text):
            for unit in (u for c in chunks for u in encoder.v.unit.findall(c)):
                if held and length + len(unit) > size:
                    yield row, doc_id, at, 0, True, None, " ".join(held)
                    at, held, length = at + 1, [], 0
                if len(unit) <= size:
                    held.append(unit)
                    length += len(unit)
                    continue
                for part, start in enumerate(range(0, len(unit), size)):
                    yield row, doc_id, at, part, start + size >= len(unit), None, unit[start : start + size]
                at += 1
            if special is not None:
                yield row, doc_id, at, 0, True, None, " ".join(held)
                yield row, doc_id, at + 1, 0, True, special, ""
                at, held, length = at + 2, [], 0
        yield row, doc_id, at, 0, True, None, " ".join(held)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary))
        for batch in batches:
            for row in batch.to_pylist():
                for piece in cut(row["row"], row["doc_id"], row["body"], encoder):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(piece, piece_schema)], schema=piece_schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary))
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["special"] is not None:
                    ids = [r["special"]]
                elif r["ends"] and r["part"] == 0:
                    ids = [i for u in r["body"].split(" ") if u for i in encoder.encode(encoder.symbols(u))]
                else:
                    ids = encoder.encode(encoder.symbols(r["body"], r["ends"]))
                out.append(_packed(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], schema=coded_schema)

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["at"], r["part"]))
        encoder, out = Encoder(Vocabulary(vocabulary)), []
        for _, parts in groupby(rows, key=lambda r: r["at"]):
            level = [np.frombuffer(r["ids"], "<u4").tolist() for r in parts]
            while len(level) > 1:
                level = [encoder.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            out.append(_packed(level[0]))
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": pa.array([b"".join(out)], pa.binary())})

    numbered = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body")
    pieces = stage(numbered.mapInArrow(pieces_of, _PIECE), "pieces")
    ids = pieces.repartition("row", "at", "part").mapInArrow(coded, _CODED)
    return ids.groupBy("row").applyInArrow(joined, "doc_id long, ids binary")
