"""Delimited text with line breaks in quotes, read by many tasks a file.

Lines are read in ranges of their files. Whether a line begins within quotes depends on all quotes
before it, so each line is seen as a map from the state it begins in to the one it ends in. A first
scan composes the maps of a range to one, lines without quotes never leave the scan, and a table of
one line per range carries the state from range to range. A second scan then knows where records
begin and puts their lines together; pieces of records that cross ranges are the only rows that
are shuffled. Where no record crosses a line, the ordinary reader is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.scratch import stage
from burnish.functions.types import col

#: Read for an empty cell without quotes, so that it is told from a quoted empty text. Two code points of no meaning.
NO_VALUE = "\ue000\ue001"
#: States of the scan of a line: out of quotes, in them, just out of them, at the start of a record.
_OUT, _IN, _CLOSED, _START = 0, 1, 2, 3

_RANGE = "block long, file long, start long, from_out boolean, from_in boolean, begins boolean"
_RECORD = "file long, opens long, at long, first boolean, record string"


def reader_options(sep: str) -> dict[str, object]:
    return {"header": True, "sep": sep, "escape": '"', "nullValue": NO_VALUE, "emptyValue": ""}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their files' ranges, with the range they lie in."""
    meta = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64(*meta).alias("block"), F.xxhash64(meta[0]).alias("file"), meta[1].alias("start")
    )


def ends_inside(value: Column, sep: str, inside: bool) -> Column:
    """Whether a line ends within quotes, by whether it begins there.

    A quote opens at the start of a cell only; a doubled one within quotes is a sign of the text.
    """
    pieces = F.split(value, '"', -1)

    def step(state: Column, piece: Column) -> Column:
        opens = F.endswith(piece, F.lit(sep)) | ((piece == "") & (state >= _CLOSED))
        return F.when(state == _IN, _CLOSED).when(opens, _IN).otherwise(_OUT)

    walked = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.lit(_IN if inside else _START), step)
    return F.when(F.contains(value, F.lit('"')), walked == _IN).otherwise(F.lit(inside))


def _states(from_out: np.ndarray, from_in: np.ndarray, state: bool) -> np.ndarray:
    """The states at the start of each line and after the last one, when the first begins in ``state``."""
    fixed, swaps = from_out == from_in, np.cumsum(from_out & ~from_in)
    place = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    before = np.maximum(place, 0)
    known = np.where(place >= 0, from_out[before] ^ ((swaps - swaps[before]) & 1).astype(bool), state ^ (swaps & 1).astype(bool))
    return np.concatenate([[state], known]).astype(bool)


def _ranges(lines: DataFrame, sep: str) -> DataFrame:
    """The map of each range, and whether a record begins in it although it begins within quotes."""
    tagged = lines.select("block", "file", "start", *(ends_inside(F.col("value"), sep, s).alias(n) for n, s in (("from_out", False), ("from_in", True))))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][:1] - 1)) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                block, file, start = (int(c[a]) for c in columns[:3])
                now = held.setdefault(block, [block, file, start, False, True, False])
                maps = [c[a:b].astype(bool) for c in columns[3:]]
                outside, inside = _states(*maps, now[3]), _states(*maps, now[4])
                now[3], now[4], now[5] = bool(outside[-1]), bool(inside[-1]), now[5] or not inside[:-1].all()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*held.values())], ["block", "file", "start", "from_out", "from_in", "begins"])

    return tagged.mapInArrow(composed, _RANGE)


def _crossed(ranges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that begin within quotes, and where the range lies in which that record begins."""
    by_file = Window.partitionBy("file").orderBy("start")
    before, until = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.coalesce(F.sum(F.when(F.expr("from_out and not from_in"), 1).otherwise(0)).over(until), F.lit(0))
    counted = ranges.withColumn("swaps", swaps)
    fixed = F.last(F.when(F.expr("from_out = from_in"), F.struct("from_out", "swaps")), ignorenulls=True).over(before)
    counted = counted.withColumn("fixed", fixed).withColumn("done", F.lag("swaps", 1, 0).over(by_file))
    odd = (F.col("done") - F.coalesce(F.col("fixed.swaps"), F.lit(0))) % 2 == 1
    counted = counted.withColumn("inside", F.coalesce(F.col("fixed.from_out"), F.lit(False)) != odd)
    opens = F.last(F.when(~F.col("inside") | F.col("begins"), F.col("start")), ignorenulls=True).over(before)
    # One line for each range that begins within quotes: 16 bytes.
    found = counted.withColumn("opens", opens).where("inside").select("block", "opens").orderBy("block").toArrow()
    return found.column("block").to_numpy(), found.column("opens").to_numpy()


def _records(lines: DataFrame, sep: str, blocks: np.ndarray, opens: np.ndarray) -> DataFrame:
    """Whole records without ``file``; pieces of records that cross ranges with it."""
    tagged = lines.select("block", "file", "start", *(ends_inside(F.col("value"), sep, s).alias(n) for n, s in (("from_out", False), ("from_in", True))), "value")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        place: tuple[int, int, int] = (0, 0, 0)
        state, opened, first = False, None, False

        def joined(values: pa.Array, starts: np.ndarray) -> pa.Array:
            offsets = pa.array(np.append(starts, len(values)), pa.int32())
            return pc.binary_join(pa.ListArray.from_arrays(offsets, values), "\n")

        def rest() -> Iterator[pa.RecordBatch]:
            """What is left at the end of a range: a record, or a piece of one."""
            if held:
                values = pa.concat_arrays(held)
                crosses = state or opened is not None
                opener = opened if opened is not None else place[2]
                yield batch_of(joined(values, np.array([0])), (place[1], opener, place[2], first) if crosses else None)
                held.clear()

        def batch_of(records: pa.Array, piece: tuple | None) -> pa.RecordBatch:
            n = len(records)
            file, opener, at, lead = piece or (None, None, None, first)
            columns = [pa.array([x] * n, t) for x, t in ((file, pa.int64()), (opener, pa.int64()), (at, pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([lead] + [False] * (n - 1), pa.bool_()), records], ["file", "opens", "at", "first", "record"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else []
            for a, b in zip(cuts, [*cuts[1:], len(ids)]):
                now = tuple(int(batch.column(i)[int(a)].as_py()) for i in range(3))
                if now != place:
                    yield from rest()
                    place, first = now, now[2] == 0
                    at = np.searchsorted(blocks, now[0])
                    state = at < len(blocks) and blocks[at] == now[0]
                    opened = int(opens[at]) if state else None
                values = batch.column(5).slice(int(a), int(b - a))
                states = _states(*(batch.column(i).slice(int(a), int(b - a)).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4)), state)
                state, starts = bool(states[-1]), np.flatnonzero(~states[:-1])
                if not len(starts):
                    held.append(values)
                    continue
                if opened is not None:
                    held.append(values.slice(0, int(starts[0])))
                    yield from rest()
                    opened = None
                elif held:
                    held.append(values.slice(0, int(starts[0])))
                    yield batch_of(joined(pa.concat_arrays(held), np.array([0])), None)
                    held.clear()
                    first = False
                if len(starts) > 1:
                    yield batch_of(joined(values.slice(int(starts[0]), int(starts[-1] - starts[0])), starts[:-1] - starts[0]), None)
                    first = False
                held.append(values.slice(int(starts[-1])))
        yield from rest()

    return tagged.mapInArrow(put_together, _RECORD)


def _inferred(cells: DataFrame) -> T.StructType:
    """Types of text columns, one aggregate: whole numbers, numbers, dates, times, booleans, else text."""
    whole, number = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    tests = {
        "int": lambda c: c.rlike(whole) & c.try_cast("int").isNotNull(),
        "bigint": lambda c: c.rlike(whole) & c.try_cast("bigint").isNotNull(),
        "double": lambda c: c.rlike(number) | c.isin("NaN", "Inf", "-Inf"),
        "date": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(),
        "timestamp": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}") & c.try_cast("timestamp").isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
    }
    names = cells.columns
    seen = {f"{i}_{t}": F.bool_and(F.when(col(n).isNotNull(), test(col(n)))) for i, n in enumerate(names) for t, test in tests.items()}
    row = cells.select(*(F.nullif(col(n), F.lit("")).alias(n) for n in names)).agg(*(c.alias(k) for k, c in seen.items())).first()
    return T.StructType([T.StructField(n, T.StructType.fromDDL("x " + next((t for t in tests if row[f"{i}_{t}"]), "string"))[0].dataType) for i, n in enumerate(names)])


def read_quoted(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header in which quoted cells may hold line breaks.

    The files are scanned when this is called, to find where records begin. Lines end in a line feed,
    or carriage return and line feed. Quotes are doubled within quotes. A quoted empty cell is an
    empty text, one without quotes is null.
    """
    options = reader_options(sep)
    lines = _lines(spark, path)
    carriage = F.contains(F.rtrim("value", F.lit("\r")), F.lit("\r"))
    broken = lines.where(ends_inside(F.col("value"), sep, False) | carriage).limit(1).count()
    if not broken:
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    ranges = stage(_ranges(lines, sep), "ranges")
    if ranges.groupBy("block").count().where("count > 1").limit(1).count():
        raise ValueError("Two ranges of the files share a name: read them with multi_line=True.")
    found = _records(lines, sep, *_crossed(ranges))
    pieces = found.where("file is not null").groupBy("file", "opens").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda x: x["record"]), "\n").alias("record")
    )
    records = found.where("file is null").select("first", "record").union(pieces.select("first", "record"))
    text = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    records = records.where("not first").select(text.alias("record")).where("record <> ''")
    if schema is None:
        names = spark.read.options(**options, multiLine=True).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        schema = _inferred(_parsed(records, schema, options))
    return _parsed(records, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema, options)


def _parsed(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """Columns of the records. Line breaks within quotes stay as they are written."""
    settings = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()} | {"multiLine": "true", "header": "false"}
    return records.select(F.from_csv("record", _ddl(schema), settings).alias("x")).select("x.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
