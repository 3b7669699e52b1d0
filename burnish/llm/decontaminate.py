"""Benchmark decontamination by templates.

Numbers, names and units are replaced by typed placeholders. Windows of template words are joined by
hash with those of the benchmark; where a window has placeholders, its words as written are joined
as well. An alignment of a document with an item may give the item's slots other values, but always
the same one for the same value: that is a question with new parameters. Otherwise only windows
that agree word by word count. A capitalised word that opens a sentence may be a name or not, so its
windows come both ways. Windows with too few words meet no others by hash; where other windows align
a document with an item, they are compared place by place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.llm.frames import arrow_schema

#: Words of a window, the least of them that are no placeholders, and the share of an item's windows that a leak holds.
WINDOW, LITERAL, SHARE = 5, 3, 0.8
#: log2 of the bits of the filter that tasks look windows up in: 2 MB, whatever the benchmark.
FILTER_BITS = 24
CACHED = 1 << 18

#: Units of measure, in the plural too.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp yen percent degree degrees celsius fahrenheit kelvin hz khz mhz ghz w kw watt watts v volt volts j joule joules "
    "n newton newtons pa pascal pascals kb mb gb tb byte bytes bit bits mph kph".split()
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n:]")
_WORD, _NUMBER, _NAME, _UNIT, _STOP = range(5)
_WINDOWS = "key long, at long, hash long, slots array<string>, kind int"
#: Kinds of windows: as written, template, template whose sentence openers are names, template with too few words.
_WRITTEN, _TEMPLATE, _OPENER, _DENSE = range(4)


def _kind(token: str) -> int:
    if token[0].isdigit():
        return _NUMBER
    if not token[0].isalpha():
        return _STOP
    if token.lower() in UNITS:
        return _UNIT
    return _NAME if token[0].isupper() else _WORD


class Numbered(dict):
    """Numbers for tokens in the order in which they are met; ``new`` lists those that nobody has looked at yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.new.append(token)
        return number


class Templates:
    """Hashes of a text's windows; keeps the tokens met so far."""

    def __init__(self, window: int = WINDOW, literal: int = LITERAL):
        self.window, self.literal = window, literal
        random = np.random.default_rng(5)
        self.powers = random.integers(0, 1 << 63, window, np.uint64) | np.uint64(1)
        self.marks = random.integers(0, 1 << 63, 5, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.hashes, self.kinds = np.zeros(CACHED, np.uint64), np.zeros(CACHED, np.int8)

    def look_up(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.forget()
        places = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        if new := self.known.new:
            self.known.new = []
            size, first = len(self.known), len(self.known) - len(new)
            if size > len(self.hashes):
                more = max(size, 2 * len(self.hashes)) - len(self.hashes)
                self.hashes, self.kinds = np.pad(self.hashes, (0, more)), np.pad(self.kinds, (0, more))
            self.hashes[first:size] = np.fromiter((xxhash.xxh64_intdigest(t.lower()) for t in new), np.uint64, len(new))
            self.kinds[first:size] = np.fromiter(map(_kind, new), np.int8, len(new))
        return places

    def _rolled(self, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The hashes of the windows at ``places``; all windows from slices, fewer from picked ones."""
        n = len(hashes) - self.window + 1
        out = np.zeros(len(places), np.uint64)
        for k in range(self.window):
            out += (hashes[k : n + k] if len(places) == n else hashes[places + k]) * self.powers[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def windows(self, text: str | None, wanted: np.ndarray | None = None, kinds_of: tuple[int, ...] = (_WRITTEN, _TEMPLATE, _OPENER)) -> Iterator[tuple[int, int, list[str], int]]:
        """(place, hash, slot values, kind) of the windows, of those whose bit is set in ``wanted`` if it is given.

        A window comes as written, without slots, and if it has placeholders as a template too; with
        a capitalised opener of a sentence, as a template in which that is a name as well.
        """
        tokens = _TOKEN.findall(text or "")
        ids = self.look_up(tokens)
        kinds = self.kinds[ids]
        words = np.flatnonzero(kinds != _STOP)
        if len(words) < self.window:
            return
        opens = np.concatenate([[True], kinds[:-1] == _STOP])[words]
        hashes, kinds = self.hashes[ids[words]], kinds[words]
        opens &= kinds == _NAME  # a sentence starts in upper case
        kinds[(kinds == _UNIT) & (np.concatenate([[_WORD], kinds[:-1]]) != _NUMBER)] = _WORD
        named = kinds != _WORD
        slots = named & ~opens
        found = [(_WRITTEN, None, np.arange(len(words) - self.window + 1))]
        for kind, own, some in ((_TEMPLATE, slots, slots), (_OPENER, named, opens)):
            if some.any():
                count, use = self._held(own), np.flatnonzero(self._held(some))
                enough = self.window - count[use] >= self.literal
                found += [(kind, own, use[enough]), (_DENSE, own, use[~enough])]
        for kind, own, places in found:
            if kind not in kinds_of or not len(places):
                continue
            values = self._rolled(hashes if own is None else np.where(own, self.marks[kinds], hashes), places)
            if wanted is not None:
                bit = values >> np.uint64(64 - FILTER_BITS)
                hit = ((wanted[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                places, values = places[hit], values[hit]
            for at, value in zip(places.tolist(), values.astype(np.int64).tolist()):
                inside = [] if own is None else [tokens[words[i]].lower() for i in range(at, at + self.window) if own[i]]
                yield at, value, inside, kind

    def _held(self, marked: np.ndarray) -> np.ndarray:
        """How many marked words each window holds."""
        sums = np.concatenate([[0], np.cumsum(marked)])
        return sums[self.window :] - sums[: -self.window]


def _windows(df: DataFrame, wanted: np.ndarray | None, window: int, literal: int, kinds_of: tuple[int, ...]) -> DataFrame:
    """Windows of the rows (key, body)."""
    schema = arrow_schema(_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(window, literal)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(key, *found) for found in templates.windows(text, wanted, kinds_of)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return df.mapInArrow(run, _WINDOWS)


def _found(aligned: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_found, new_parameters`` of alignments (as_written, as_template, pairs, optional).

    All is judged as written if a value of ``pairs`` stands for another one anywhere. An ``optional``
    window counts unless optional windows give one of its values two meanings.
    """
    # One value of the item, one of the document: as many pairs as values on the item's side.
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    known = F.array_distinct(F.concat("pairs", F.flatten(F.transform("optional", lambda o: o["pairs"]))))
    clear = ~F.exists("known", lambda p: F.exists("pairs", lambda q: (q["a"] == p["a"]) & (q["b"] != p["b"])))
    torn = F.filter("known", lambda p: F.exists("known", lambda q: (q["a"] == p["a"]) & (q["b"] != p["b"])))
    fits = F.transform(F.filter("optional", lambda o: ~F.arrays_overlap(o["pairs"], F.col("torn"))), lambda o: o["item_at"])
    places = F.when(consistent & clear, F.array_union(F.array_union("as_written", "as_template"), fits)).otherwise(F.col("as_written"))
    found = aligned.withColumn("known", known).withColumn("torn", torn).select("doc_id", "item_id", F.explode(places).alias("item_at"), "as_written")
    found = found.select("doc_id", "item_id", "item_at", (~F.array_contains("as_written", F.col("item_at"))).alias("other"))
    per_place = found.groupBy("doc_id", "item_id", "item_at").agg(F.min("other").alias("other"))
    return per_place.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"), F.max("other").alias("new_parameters"))


def leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, literal: int = LITERAL, share: float = SHARE
) -> DataFrame:
    """``doc_id, item_id, n_windows, n_found, share, new_parameters``: documents that hold at least ``share`` of an item's windows.

    Case and punctuation do not matter. ``new_parameters`` tells that some windows agree only as
    templates. Items of fewer words than a window, null texts and null item keys match nothing.
    Rows that repeat a key are judged as one document, rows that repeat an item key as one item;
    other columns are ignored; an empty table on either side gives an empty result.

    Only a filter of 2 ** FILTER_BITS bits made of the benchmark's windows is collected; windows that
    pass it are joined exactly. All work on a document is keyed by document and item.
    """
    items = benchmark.where(f"{item_key} is not null").select(F.col(item_key).cast("long").alias("key"), F.col(item_text).cast("string").alias("body"))
    every = (_WRITTEN, _TEMPLATE, _OPENER, _DENSE)
    renamed = {"key": "item_id", "at": "item_at", "slots": "item_slots", "kind": "item_kind"}
    own = stage(_windows(items, None, window, literal, every).withColumnsRenamed(renamed).distinct(), "windows")
    met, dense = own.where(F.col("item_kind") != _DENSE), own.where(F.col("item_kind") == _DENSE)
    bit = f"shiftrightunsigned(hash, {64 - FILTER_BITS})"
    filled = met.groupBy(F.expr(f"shiftright({bit}, 3)").alias("byte")).agg(F.expr(f"bit_or(shiftleft(1, cast({bit} % 8 as int)))").alias("bits"))
    wanted = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for byte, bits in filled.toLocalIterator():
        wanted[byte] = bits
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("body"))
    hits = _windows(source, wanted, window, literal, every[:_DENSE]).withColumnsRenamed({"key": "doc_id"})
    alignment = ["doc_id", "item_id", "shift"]
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    place = F.struct("item_at", pairs.alias("pairs"))
    matches = hits.join(met, "hash").withColumn("shift", F.col("at") - F.col("item_at")).withColumn("as", F.greatest("kind", "item_kind"))
    aligned = matches.groupBy(alignment).agg(
        F.collect_set(F.when(F.col("as") == _WRITTEN, F.col("item_at"))).alias("as_written"),
        F.collect_set(F.when(F.col("as") == _TEMPLATE, F.col("item_at"))).alias("as_template"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("as") == _TEMPLATE, pairs)))).alias("pairs"),
        F.collect_set(F.when(F.col("as") == _OPENER, place)).alias("optional"),
    )
    aligned = stage(aligned, "aligned")
    sizes = own.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_windows"), F.count_distinct(F.when(F.col("item_kind") == _DENSE, F.col("item_at"))).alias("n_dense"))
    # Dense windows are compared for items that can leak with them, at the places that an alignment names.
    open_ = _found(aligned).join(sizes, "item_id").where((F.col("n_dense") > 0) & (F.col("n_found") + F.col("n_dense") >= share * F.col("n_windows")))
    open_ = stage(open_.select(F.col("doc_id").alias("key"), F.col("item_id").alias("open_item")), "open")
    again = _windows(source.alias("s").join(open_.select("key").distinct().alias("o"), F.expr("s.key <=> o.key"), "left_semi"), None, window, literal, (_DENSE,))
    asked = aligned.join(open_, F.expr("doc_id <=> key and item_id = open_item"), "left_semi").select(alignment).join(dense, "item_id")
    asked = asked.withColumnsRenamed({"hash": "item_hash"}).join(again, F.expr("doc_id <=> key and item_at + shift = at and item_hash = hash"))
    more = asked.groupBy(alignment).agg(F.collect_set(place).alias("more")).select(*[F.col(c).alias(f"more_{c}") for c in alignment], "more")
    aligned = aligned.join(more, F.expr("doc_id <=> more_doc_id and item_id = more_item_id and shift = more_shift"), "left")
    aligned = aligned.withColumn("optional", F.when(F.col("more").isNull(), F.col("optional")).otherwise(F.concat("optional", "more")))
    out = _found(aligned).join(sizes, "item_id").withColumn("share", F.col("n_found") / F.col("n_windows"))
    return out.where(F.col("share") >= share).select("doc_id", "item_id", "n_windows", "n_found", "share", "new_parameters")
