"""Versioned tables: sets of columns or rows in Parquet, and an append-only log of what happened.

A whole snapshot gives each row an id. A version that follows from it by changing some columns,
leaving out rows, or renaming and dropping columns writes only those columns, the ids of the rows
that stay, or nothing; its layout names the set that each column is read from, and sets are joined
by row id when they are read together. Sets are never changed, so versions share them.

The log is a small table: one line per commit, checkout or deletion. A commit is its line, written
after the data: without it the version does not exist. The history is a tree; the current version
is the one the last line points to.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.ordering import with_row_index
from burnish.functions.types import as_columns, col, quoted
from burnish.operators.profile import measure
from burnish.operators.profile_state import STATE_SCHEMA, column_states

LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("version_id", T.StringType()),
        T.StructField("entry", T.StringType()),
    ]
)
TIMELINE_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("quality_score", T.IntegerType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("rows_affected", T.LongType()),
        T.StructField("sql", T.StringType()),
        T.StructField("datasets_used", T.ArrayType(T.StringType())),
        T.StructField("actions", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("col_count", T.IntegerType()),
    ]
)
#: Positions under order_by, and ids that rows keep from one whole snapshot to the next.
ROW_INDEX, ROW_ID = "__row", "__id"
#: A version that would be read from more sets than this is written whole.
MOST_SETS = 4


@dataclass
class Version:
    id: str
    label: str
    description: str
    timestamp: float
    quality_score: int = 0
    parent_id: str | None = None
    operation: str = ""
    rows_affected: int = 0
    sql: str | None = None
    datasets_used: list[str] = field(default_factory=list)
    actions: str | None = None
    row_count: int = 0
    col_count: int = 0
    layout: dict | None = None

    @property
    def columns(self) -> list[list[str]]:
        """[name, set, name in the set] of each column."""
        return self.layout["columns"]

    @property
    def sets(self) -> set[str]:
        return {self.layout["base"], self.layout["rows"] or self.layout["base"], *(c[1] for c in self.columns)}


class VersionStore:
    """Versions under ``path``; one writer at a time.

    With ``order_by`` each version has its row positions, so versions can be compared row by
    row; otherwise compare by key.
    """

    def __init__(self, spark: SparkSession, path: str, order_by=None):
        self.spark, self.path, self.order_by = spark, path.rstrip("/"), order_by
        self._lines: list[tuple] | None = None

    # -- log --------------------------------------------------------------------------------

    def _log(self) -> list[tuple]:
        """Log lines (seq, kind, version id, entry): one per user action, read once."""
        if self._lines is None:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
            if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
                lines = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log").orderBy("seq").collect()
                self._lines = [tuple(line) for line in lines]
            else:
                self._lines = []
        return self._lines

    def _append(self, kind: str, version_id: str, entry: str = "") -> None:
        line = (len(self._log()), kind, version_id, entry)
        values = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(line, LOG_SCHEMA.fields)]
        self.spark.range(1).coalesce(1).select(*values).write.mode("append").parquet(f"{self.path}/log")
        self._lines.append(line)

    def _state(self) -> tuple[list[Version], str | None]:
        """Versions in order of creation, re-parented and relabelled, and the current id."""
        versions: dict[str, Version] = {}
        current = None
        for _, kind, version_id, entry in self._log():
            if kind == "commit":
                versions[version_id] = Version(**json.loads(entry))
            if kind == "delete":
                gone = versions.pop(version_id)
                for v in versions.values():
                    if v.parent_id == gone.id:
                        v.parent_id = gone.parent_id
            else:
                current = version_id
        for i, v in enumerate(versions.values()):
            v.label = "v1 Original" if i == 0 else f"v{i + 1} {v.operation.replace('_', ' ').title()}"
        return list(versions.values()), current

    @property
    def versions(self) -> list[Version]:
        return self._state()[0]

    @property
    def current_id(self) -> str | None:
        return self._state()[1]

    def _find(self, version_id: str) -> Version | None:
        return next((v for v in self.versions if v.id == version_id), None)

    # -- commits ----------------------------------------------------------------------------

    def create_initial(self, df: DataFrame, quality_score: int | None = 0) -> Version:
        return self._commit(df, "load", "Dataset loaded", None, quality_score=quality_score, rows_affected=None)

    def commit(
        self,
        df: DataFrame,
        operation: str,
        description: str = "",
        quality_score: int | None = 0,
        rows_affected: int | None = 0,
        sql: str | None = None,
        datasets_used: list[str] = (),
        actions: list[dict] | None = None,
    ) -> Version:
        """Write a snapshot as a child of the current version and make it current.

        With None as ``quality_score`` the written snapshot is profiled for it; with None as
        ``rows_affected`` the snapshot's rows count.
        """
        return self._commit(
            df, operation, description, self.current_id, quality_score=quality_score, rows_affected=rows_affected,
            sql=sql, datasets_used=list(datasets_used), actions=json.dumps(actions) if actions else None,
        )

    def _folder(self, set_id: str) -> str:
        return f"{self.path}/versions/{set_id}"

    def _commit(self, df: DataFrame, operation: str, description: str, parent: str | None, rows_affected, **more) -> Version:
        """A whole snapshot, under new row ids."""
        version_id = uuid.uuid4().hex[:12]
        df = df.drop(ROW_ID)
        columns = [[c, version_id, c] for c in df.columns]
        if self.order_by is not None:
            df = with_row_index(df, as_columns(self.order_by), ROW_INDEX)
        df.withColumn(ROW_ID, F.monotonically_increasing_id()).write.parquet(self._folder(version_id))
        # Row count from the written files' footers.
        rows = self.spark.read.parquet(self._folder(version_id)).count()
        layout = {"base": version_id, "rows": None, "columns": columns}
        return self._enter(version_id, layout, rows, operation, description, parent, rows if rows_affected is None else rows_affected, **more)

    def _enter(self, version_id: str, layout: dict, rows: int, operation: str, description: str, parent: str | None, rows_affected: int, **more) -> Version:
        """The line that makes the version exist."""
        if more.get("quality_score", 0) is None:
            more["quality_score"] = measure(self._read(layout).drop(ROW_INDEX, ROW_ID))["quality_score"]
        version = Version(
            id=version_id, label="", description=description, timestamp=time.time(), parent_id=parent, operation=operation,
            rows_affected=rows_affected, row_count=rows, col_count=len(layout["columns"]), layout=layout, **more,
        )
        self._append("commit", version_id, json.dumps(asdict(version)))
        return self._find(version_id)

    def tracked(self) -> DataFrame:
        """The current version with the ids of its rows, for commit_cells() and commit_rows()."""
        return self._read(self._find(self.current_id).layout).drop(ROW_INDEX)

    def _current(self) -> Version:
        current = self._find(self.current_id) if self.current_id else None
        if current is None:
            raise ValueError("There is no version to change.")
        return current

    def commit_columns(self, columns: list[tuple[str, str]], operation: str, description: str = "", actions: list[dict] | None = None, **more) -> Version:
        """The current version's columns under (new name, old name), in that order. Writes no data."""
        parent = self._current()
        place = {c[0]: c[1:] for c in parent.columns}
        layout = {**parent.layout, "columns": [[new, *place[old]] for new, old in columns]}
        more = {"quality_score": 0, "rows_affected": 0, **more}
        return self._enter(uuid.uuid4().hex[:12], layout, parent.row_count, operation, description, parent.id, actions=json.dumps(actions) if actions else None, **more)

    def commit_cells(self, df: DataFrame, columns: list[str], operation: str, description="", actions: list[dict] | None = None, rows_affected=0, **more) -> Version:
        """``df``, the rows of tracked() with other values in ``columns``: writes these columns alone.

        ``description`` and ``rows_affected`` may be functions, called when the data are written.
        A column that orders the rows, or too many sets to read together, lead to a whole snapshot.
        """
        parent, set_id = self._current(), uuid.uuid4().hex[:12]
        kept = [c for c in parent.columns if c[0] not in columns]
        layout = {**parent.layout, "columns": [[c[0], set_id, c[0]] if c[0] in columns else c for c in parent.columns]}
        recorded = json.dumps(actions) if actions else None
        if not columns:
            return self.commit_columns([(c[0], c[0]) for c in parent.columns], operation, _said(description), actions, rows_affected=_said(rows_affected), **more)
        if 2 * len(kept) < len(parent.columns) or self._orders(columns) or len({layout["base"], layout["rows"], *(c[1] for c in layout["columns"])} - {None}) > MOST_SETS:
            return self._commit(df.select(*[col(c[0]) for c in parent.columns]), operation, _said(description), parent.id, _said(rows_affected), actions=recorded, **more)
        df.select(ROW_ID, *[col(c) for c in columns]).write.parquet(self._folder(set_id))
        return self._enter(set_id, layout, parent.row_count, operation, _said(description), parent.id, _said(rows_affected), actions=recorded, **more)

    def commit_rows(self, df: DataFrame, operation: str, description="", actions: list[dict] | None = None, **more) -> Version:
        """``df``, some of the rows of tracked(): writes their ids, and with order_by their positions.

        ``description`` may be a function of the number of rows that went.
        """
        parent, set_id = self._current(), uuid.uuid4().hex[:12]
        layout = {**parent.layout, "rows": set_id}
        recorded = json.dumps(actions) if actions else None
        whole = len({layout["base"], set_id, *(c[1] for c in layout["columns"])}) > MOST_SETS
        if self.order_by is not None and not whole:
            df = with_row_index(df.select(ROW_ID, *as_columns(self.order_by)), as_columns(self.order_by), ROW_INDEX).select(ROW_ID, ROW_INDEX)
        elif not whole:
            df = df.select(ROW_ID)
        if whole:
            df = df.drop(ROW_ID)
            layout = {"base": set_id, "rows": None, "columns": [[c[0], set_id, c[0]] for c in parent.columns]}
            if self.order_by is not None:
                df = with_row_index(df, as_columns(self.order_by), ROW_INDEX)
            df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
        df.write.parquet(self._folder(set_id))
        rows = self.spark.read.parquet(self._folder(set_id)).count()
        gone = parent.row_count - rows
        return self._enter(set_id, layout, rows, operation, description(gone) if callable(description) else description, parent.id, gone, actions=recorded, **more)

    def _orders(self, columns: list[str]) -> bool:
        """Whether the order of the rows may depend on the columns; of expressions that is not known."""
        if self.order_by is None:
            return False
        named = [self.order_by] if isinstance(self.order_by, (str, Column)) else list(self.order_by)
        return any(not isinstance(c, str) or c in columns for c in named)

    # -- reading ----------------------------------------------------------------------------

    def _read(self, layout: dict, names: list[str] | None = None) -> DataFrame:
        """Columns of a layout with ROW_ID, and ROW_INDEX if it is stored. Only the sets that hold them are read."""
        chosen = [c for c in layout["columns"] if names is None or c[0] in names]
        rows = layout["rows"] or layout["base"]
        sets = dict.fromkeys([rows, *(c[1] for c in chosen)])
        index = [ROW_INDEX] if self.order_by is not None else []
        out = None
        for set_id in sets:
            stored = self.spark.read.parquet(self._folder(set_id))
            part = stored.select(ROW_ID, *(index if set_id == rows else []), *[col(c[2]).alias(c[0]) for c in chosen if c[1] == set_id])
            out = part if out is None else out.join(part, ROW_ID)
        return out.select(*[col(c[0]) for c in chosen], ROW_ID, *index)

    def _snapshot(self, version_id: str, names: list[str] | None = None) -> DataFrame:
        return self._read(self._find(version_id).layout, names)

    def get_version(self, version_id: str) -> DataFrame | None:
        if self._find(version_id) is None:
            return None
        return self._snapshot(version_id).drop(ROW_INDEX, ROW_ID)

    def checkout(self, version_id: str) -> DataFrame | None:
        df = self.get_version(version_id)
        if df is not None:
            self._append("checkout", version_id)
        return df

    def get_current(self) -> DataFrame | None:
        current = self.current_id
        return self.get_version(current) if current else None

    def undo(self) -> DataFrame | None:
        """Go to the parent of the current version, if it has one."""
        current = self._find(self.current_id) if self.current_id else None
        return self.checkout(current.parent_id) if current and current.parent_id else None

    def redo(self) -> DataFrame | None:
        """Go to the oldest child of the current version, if it has one."""
        versions, current = self._state()
        child = next((v for v in versions if current and v.parent_id == current), None)
        return self.checkout(child.id) if child else None

    def get_timeline(self) -> DataFrame:
        rows = [{"position": i, **asdict(v)} for i, v in enumerate(self.versions)]
        for r in rows:
            del r["layout"]
        return self.spark.createDataFrame(rows, TIMELINE_SCHEMA)

    def delete_version(self, version_id: str) -> bool:
        """Take a version out of the history; its children move to its parent.

        The first and the current version stay.
        """
        versions, current = self._state()
        if version_id not in [v.id for v in versions]:
            return False
        if version_id == versions[0].id or version_id == current:
            raise ValueError("The original and the current version cannot be deleted.")
        self._append("delete", version_id)
        own = next(v.sets for v in versions if v.id == version_id)
        for set_id in own.difference(*(v.sets for v in versions if v.id != version_id)):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(set_id))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return True

    # -- comparison -------------------------------------------------------------------------

    def diff(self, version_a: str, version_b: str, key: list[str] | None = None) -> DataFrame:
        """table_diff of two versions, row by row position or by key; only columns that may differ are read."""
        if key is None and self.order_by is None:
            raise ValueError("Comparing by position needs a store with order_by; or pass key.")
        first, second = self._find(version_a), self._find(version_b)
        place = {c[0]: c[1:] for c in second.columns}
        same_rows = key is None and (first.layout["base"], first.layout["rows"]) == (second.layout["base"], second.layout["rows"])
        # Of the same rows, columns that are read from the same place are equal: they are not read.
        equal = [c[0] for c in first.columns if same_rows and place.get(c[0]) == c[1:]]
        a, b = (self._snapshot(v.id, [c[0] for c in v.columns if c[0] not in equal]) for v in (first, second))
        found = table_diff(a, b, key or [ROW_INDEX], hidden=[ROW_INDEX, ROW_ID])
        if not equal:
            return found
        n = first.row_count
        lines = [(c, 0, 0, n, 0.0 if n else None) for c in equal]
        return found.unionAll(self.spark.createDataFrame(lines, found.schema)).orderBy(F.desc("cells_changed"), "column_name")

    def profile_states(self, version_id: str) -> DataFrame:
        """The column states of a version (see profile_state), kept in the store.

        A column is profiled once for the rows and the set that it is read from: versions that
        share them share its state, and only the others are read.
        """
        version = self._find(version_id)
        rows = f"{version.layout['base']}/{version.layout['rows'] or version.layout['base']}"
        place = {c[0]: f"{rows}/{c[1]}/{c[2]}" for c in version.columns}
        folder = f"{self.path}/profiles"
        held = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        schema = T.StructType([T.StructField("place", T.StringType()), *STATE_SCHEMA.fields])
        if held.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(held):
            known = {r[0] for r in self.spark.read.schema(schema).parquet(folder).select("place").where(F.col("place").isin(list(place.values()))).distinct().collect()}
        else:
            known = set()
        new = [c for c, p in place.items() if p not in known]
        if new:
            found = column_states(self._snapshot(version_id, new), new)
            named = F.create_map(*[F.lit(x) for c in new for x in (c, place[c])])
            found.withColumn("place", named[F.col("name")]).select("place", *STATE_SCHEMA.names).write.mode("append").parquet(folder)
        states = self.spark.read.schema(schema).parquet(folder).dropDuplicates(["place"])
        columns = self.spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(place.items())], "ordinal int, column string, place string")
        return states.join(F.broadcast(columns), "place").withColumn("name", F.col("column")).select("ordinal", *STATE_SCHEMA.names)

    def compare(self, version_a: str, version_b: str) -> DataFrame:
        return table_summary(self.get_version(version_a), self.get_version(version_b))


def _said(value):
    return value() if callable(value) else value


def table_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two tables, rows gained or lost, and which columns came and went; one row."""
    added = [c for c in b.columns if c not in a.columns]
    removed = [c for c in a.columns if c not in b.columns]
    common = [c for c in a.columns if c in b.columns]

    def listed(names: list[str]):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    counts = a.agg(F.count(F.lit(1)).alias("a"), F.lit(0).cast("long").alias("b")).unionAll(
        b.agg(F.lit(0).cast("long").alias("a"), F.count(F.lit(1)).alias("b"))
    )
    return counts.agg(F.sum("a").alias("rows_a"), F.sum("b").alias("rows_b")).select(
        "rows_a",
        "rows_b",
        (F.col("rows_b") - F.col("rows_a")).alias("row_diff"),
        F.greatest(F.col("rows_b") - F.col("rows_a"), F.lit(0)).alias("rows_added"),
        F.greatest(F.col("rows_a") - F.col("rows_b"), F.lit(0)).alias("rows_removed"),
        F.lit(len(a.columns)).alias("cols_a"),
        F.lit(len(b.columns)).alias("cols_b"),
        listed(added).alias("columns_added"),
        listed(removed).alias("columns_removed"),
        listed(common).alias("columns_common"),
    )


def table_diff(a: DataFrame, b: DataFrame, key: list[str], hidden: list[str] = ()) -> DataFrame:
    """Changed cells per common column of equal type, most changed first, in one aggregate.

    Rows are matched on ``key``. ``cells_changed`` leaves out cells that are null on either side;
    ``cells_changed_nulls`` counts a null against a value.
    """
    shared = [
        f.name
        for f in a.schema.fields
        if f.name in b.columns and f.name not in hidden and f.name not in key and b.schema[f.name].dataType == f.dataType
    ]
    left = a.select(*[col(k) for k in key], *[col(c).alias(f"__a{i}") for i, c in enumerate(shared)])
    right = b.select(*[col(k) for k in key], *[col(c).alias(f"__b{i}") for i, c in enumerate(shared)])
    matched = left.join(right, [k for k in key])
    counted = matched.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"__a{i}") != F.col(f"__b{i}")).alias(f"n{i}") for i in range(len(shared))],
        *[F.count_if(~F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))).alias(f"m{i}") for i in range(len(shared))],
    )
    lines = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("cells_changed"), F.col(f"m{i}").alias("cells_changed_nulls"))
        for i, c in enumerate(shared)
    ]
    schema = "array<struct<column_name string, cells_changed long, cells_changed_nulls long>>"
    return (
        counted.select("rows", F.explode(F.array(*lines) if lines else F.from_json(F.lit("[]"), schema)).alias("l"))
        .select(
            "l.*",
            F.col("rows").alias("rows_compared"),
            F.when(F.col("rows") > 0, F.round(F.col("l.cells_changed") / F.col("rows") * 100, 2)).alias("pct_changed"),
        )
        .orderBy(F.desc("cells_changed"), "column_name")
    )


def diff_by_position(a: DataFrame, b: DataFrame, order_by, columns: list[str] | None = None) -> DataFrame:
    """table_diff of the n-th row of one table against the n-th row of the other.

    All rows are placed and compared, in ``columns`` (by default in all): only these are moved with their places.
    """
    order = as_columns(order_by)
    left, right = (with_row_index(df, order, ROW_INDEX, None if columns is None else [c for c in df.columns if c in columns]) for df in (a, b))
    return table_diff(left, right, [ROW_INDEX])


def row_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in one of two like tables, with their number of copies: ``change`` is added or removed.

    One shuffle: each row counts +1 or -1 and rows that cancel out drop.
    """
    names = [quoted(c) for c in a.columns]
    both = a.select(*names, F.lit(-1).alias("__n")).unionAll(b.select(*names, F.lit(1).alias("__n")))
    net = both.groupBy(*names).agg(F.sum("__n").alias("__n")).where(F.col("__n") != 0)
    change = F.when(F.col("__n") > 0, F.lit("added")).otherwise(F.lit("removed"))
    return net.withColumn("change", change).withColumn("copies", F.abs("__n")).drop("__n")
