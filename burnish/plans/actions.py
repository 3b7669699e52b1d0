"""Cleaning as data: a list of {type, params, target} actions folded over a table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.functions.types import fresh_name, is_text
from burnish.operators import columns as cols
from burnish.operators import relational as rel
from burnish.operators.ddl import create_table, ddl_profile
from burnish.operators.dedup import deduplicate, deduplicate_semantic, standardize
from burnish.operators.impute import fill_nulls_ml
from burnish.operators.nulls import fill_nulls, null_counts
from burnish.operators.outcome import Outcome
from burnish.operators.outliers import remove_outliers
from burnish.operators.profile import distinct_counts, profile
from burnish.plans.versions import ROW_ID, Version, VersionStore
from burnish.sources.datasets import Datasets, alias_of
from burnish.sources.writers import export


@dataclass
class Action:
    type: str
    params: dict = field(default_factory=dict)
    target: str = "all"

    @property
    def column(self) -> str | None:
        """The column named by the target, else by the parameters."""
        if self.target.startswith("column:"):
            return self.target[len("column:") :]
        return self.params.get("column")


def parse_actions(spec: str | list) -> list[Action]:
    """Actions from JSON text, a list of dicts, or a dict with ``actions``; entries without a type are skipped."""
    items = json.loads(spec) if isinstance(spec, str) else spec
    if isinstance(items, dict):
        items = items.get("actions", [])
    return [
        i if isinstance(i, Action) else Action(i["type"], i.get("params") or {}, i.get("target") or "all")
        for i in items
        if isinstance(i, Action) or (isinstance(i, dict) and i.get("type"))
    ]


def action_dicts(actions: list[Action]) -> list[dict]:
    return [{"type": a.type, "params": a.params, "target": a.target} for a in actions]


def _first(params: dict, *names: str, default=None):
    return next((params[n] for n in names if params.get(n) not in (None, "")), default)


class ActionRunner:
    """Applies actions to a table. ``order_by`` is the row order for those that depend on it.

    Actions that name other tables look them up in ``datasets``.
    """

    def __init__(self, order_by=None, datasets: Datasets | None = None, embed=None):
        self.order_by, self.datasets, self.embed = order_by, datasets, embed

    def run(self, df: DataFrame, action: Action) -> Outcome:
        """One action; the outcome's table is the input itself for actions that only report."""
        if action.type not in self.STEPS:
            raise ValueError(f"Unknown action: {action.type}")
        return self.STEPS[action.type](self, df, action)

    def apply(self, df: DataFrame, actions: str | list) -> DataFrame:
        """Fold the actions over the table."""
        for action in parse_actions(actions):
            df = self.run(df, action).df
        return df

    # -- cleaning ---------------------------------------------------------------------------

    def _deduplicate(self, df, a):
        p = a.params
        return deduplicate(
            df, p.get("strategy", "exact"), p.get("subset"), p.get("threshold", 0.85), self.order_by, p.get("block_by", ())
        )

    def _deduplicate_semantic(self, df, a):
        p = a.params
        return deduplicate_semantic(
            df, p.get("subset"), p.get("threshold", 0.92), self.order_by, p.get("embedding"), p.get("embed") or self.embed
        )

    def _standardize(self, df, a):
        return standardize(df, a.column or "", a.params.get("method", "cluster_merge"))

    def _fix_formats(self, df, a):
        return cols.fix_formats(df, a.column, a.params.get("format_type", "auto"))

    def _fill_nulls(self, df, a):
        p = a.params
        if p.get("strategy") == "ml":
            return fill_nulls_ml(df, a.column, p.get("ml_strategy", "knn"), p.get("n_neighbors", 5), self.order_by)
        return fill_nulls(df, a.column, p.get("strategy", "mode"), self.order_by, p.get("partition_by", ()))

    def _remove_outliers(self, df, a):
        return remove_outliers(df, a.column or "", a.params.get("method", "iqr"), a.params.get("threshold", 1.5))

    def _drop_columns(self, df, a):
        return cols.drop_columns(df, a.params.get("columns", []))

    def _rename_column(self, df, a):
        return cols.rename_column(df, a.params.get("from", ""), a.params.get("to", ""))

    def _filter_rows(self, df, a):
        return cols.filter_rows(df, a.params["condition"])

    # -- reports ----------------------------------------------------------------------------

    def _profile(self, df, a):
        return Outcome(df, "profile", details={"report": profile(df, self.order_by)}, template="Profiled.")

    def _generate_sql(self, df, a):
        table, engine = a.params.get("table_name", "data"), a.params.get("engine", "postgresql")
        details = {"sql": create_table(df, table, engine), "report": ddl_profile(df, engine)}
        return Outcome(df, "generate_sql", details=details, template="{sql}")

    def _export(self, df, a):
        p = a.params
        fmt = p.get("format", "csv")
        path = export(df, p.get("path", f"export.{fmt}"), fmt, p.get("table_name") or "data")
        return Outcome(df, "export", details={"path": path, "format": fmt}, template="Wrote {format} to {path}.")

    # -- queries ----------------------------------------------------------------------------

    def _table(self, df: DataFrame, name: str | None) -> DataFrame:
        if name in (None, "data"):
            return df
        if self.datasets is None:
            raise ValueError(f"No dataset named '{name}'.")
        return self.datasets[name]

    def _query(self, df, a):
        df.createOrReplaceTempView("data")
        return Outcome(df.sparkSession.sql(_first(a.params, "sql", "query")), "query")

    def _group_by(self, df, a):
        p = a.params
        by = _first(p, "by", "group_by", default=None)
        on = p.get("on")
        if by is None:
            by = p.get("column") or []
        elif on is None and p.get("function", "count") != "count":
            on = p.get("column")  # next to a key, the column is what is measured
        source = self._table(df, _first(p, "table", "from"))
        out = rel.aggregate(
            source, by, p.get("function", "count"), on, p.get("having"), p.get("columns", ()), self.order_by
        )
        return Outcome(out, "query")

    def _sort_by(self, df, a):
        p = a.params
        limit = p.get("limit")
        out = rel.sort_by(
            self._table(df, p.get("table")), _first(p, "column", "by"), _first(p, "order", "direction", default="desc"),
            int(limit) if limit else None,
        )
        return Outcome(out, "query")

    def _slice(self, df, a):
        p = a.params
        return Outcome(rel.slice_rows(self._table(df, p.get("table")), p.get("start", 0), p.get("stop", 100), self.order_by), "query")

    def _join(self, df, a):
        p = a.params
        right, on = _first(p, "right", "with"), _first(p, "on", "key")
        if not right or not on:
            raise ValueError("A join needs 'right' (a dataset) and 'on' (one or more columns).")
        left = self._table(df, _first(p, "left", "table"))
        return Outcome(rel.join_tables(left, self._table(df, right), on, _first(p, "how", "type", default="inner")), "query")

    # The names that actions are written with.
    STEPS = {
        "deduplicate": _deduplicate,
        "deduplicate_semantic": _deduplicate_semantic,
        "standardize": _standardize,
        "fix_formats": _fix_formats,
        "fill_nulls": _fill_nulls,
        "remove_outliers": _remove_outliers,
        "drop_columns": _drop_columns,
        "rename_column": _rename_column,
        "filter_rows": _filter_rows,
        "profile": _profile,
        "generate_sql": _generate_sql,
        "export": _export,
        "query": _query,
        "group_by": _group_by,
        "aggregate": _group_by,
        "sort_by": _sort_by,
        "slice": _slice,
        "join": _join,
        "merge": _join,
    }


def apply_actions(df: DataFrame, actions: str | list, order_by=None, datasets: Datasets | None = None, embed=None) -> DataFrame:
    """The table after all actions."""
    return ActionRunner(order_by, datasets, embed).apply(df, actions)


QUERY_ACTIONS = ("query", "group_by", "aggregate", "sort_by", "slice", "join", "merge")
REPORT_ACTIONS = ("profile", "generate_sql", "export")


def run_and_commit(
    store: VersionStore, actions: str | list, order_by=None, datasets: Datasets | None = None, embed=None
) -> Version | None:
    """Apply actions to the store's current version, committing a version after each.

    The log keeps each action in full, so the history can be replayed. A query's result is also
    registered as a named dataset.
    """
    runner = ActionRunner(order_by, datasets, embed)
    version = None
    for action in parse_actions(actions):
        if action.type in REPORT_ACTIONS:
            runner.run(store.get_current(), action)
            continue
        about = {"quality_score": None, "actions": action_dicts([action])}
        if action.type in LOCAL_ACTIONS and action.params.get("strategy") != "ml":
            version = _commit_change(store, runner, action, about)
            continue
        outcome = runner.run(store.get_current(), action)
        query = action.type in QUERY_ACTIONS
        version = store.commit(
            outcome.df,
            outcome.operation,
            action.params.get("description", outcome.description),
            rows_affected=None if query else outcome.rows_affected,
            sql=_first(action.params, "sql", "query") if action.type == "query" else None,
            datasets_used=datasets.names if datasets and query else [],
            **about,
        )
        if datasets is not None and query:
            name = alias_of(action.params.get("description", "result")).strip("_").lower() or "result"
            datasets.register(f"{name}.result", store.get_current(), activate=False)
    return version


#: Actions that change columns or leave out rows, and so write no more than that.
LOCAL_ACTIONS = ("standardize", "fix_formats", "fill_nulls", "drop_columns", "rename_column", "filter_rows", "remove_outliers")


def _commit_change(store: VersionStore, runner: ActionRunner, action: Action, about: dict) -> Version:
    """Commits what the action changes. Counts come from the write itself where it can tell them."""
    rows, said = store.tracked(), action.params.get("description")
    # The target as it was goes along with its new values, only to be compared when they are written.
    was = fresh_name(rows, "__was") if action.type in ("fill_nulls", "fix_formats") and action.column in rows.columns else None
    outcome = runner.run(rows.withColumn(was, cols.col(action.column)) if was else rows, action)

    def described(affected: int | None = None) -> str:
        return said if said is not None else outcome.described(affected)

    if action.type in ("filter_rows", "remove_outliers"):
        return store.commit_rows(outcome.df, outcome.operation, described, **about)
    if action.type in ("drop_columns", "rename_column"):
        new = {action.params.get("from"): action.params.get("to")} if action.type == "rename_column" else {}
        left = [c for c in rows.columns if c != ROW_ID and new.get(c, c) in outcome.df.columns]
        return store.commit_columns([(new.get(c, c), c) for c in left], outcome.operation, described(), rows_affected=outcome.rows_affected, **about)
    touched = outcome.details.get("columns") or [c for c in [outcome.details.get("column")] if c and outcome.metrics is not None]
    if not was or not touched:
        return store.commit_cells(outcome.df, touched, outcome.operation, described, rows_affected=lambda: outcome.rows_affected, **about)
    now, before = cols.col(action.column), cols.col(was)
    changed = (before.isNull() & now.isNotNull()) if action.type == "fill_nulls" else before != now
    seen = Observation()
    watched = outcome.df.observe(seen, F.count_if(changed).alias("rows_affected"))
    count = lambda: seen.get["rows_affected"]
    return store.commit_cells(watched, touched, outcome.operation, lambda: described(count()), rows_affected=count, **about)


def recorded_actions(store: VersionStore, version_id: str | None = None) -> list[Action]:
    """The actions that led from the original to a version (the current one by default)."""
    by_id = {v.id: v for v in store.versions}
    node, steps = by_id.get(version_id or store.current_id), []
    while node is not None:
        steps.append(parse_actions(node.actions) if node.actions else [])
        node = by_id.get(node.parent_id)
    return [a for step in reversed(steps) for a in step]


def replay(df: DataFrame, store: VersionStore, version_id: str | None = None, order_by=None, datasets=None, embed=None) -> DataFrame:
    """Apply a version's recorded actions to another table."""
    return apply_actions(df, recorded_actions(store, version_id), order_by, datasets, embed)


# -- automatic cleaning ---------------------------------------------------------------------

def auto_clean(df: DataFrame, order_by=None, compatible: bool = False, leave_out: list[str] = ()) -> tuple[DataFrame, list[Action]]:
    """Drop duplicate rows, repair formats, merge case variants, fill nulls by mode.

    Returns the table and the steps that changed something. Spellings are merged in every text
    column that has fewer values once lower-cased, except those named in ``leave_out``; with
    ``compatible`` a null alone also counts as a variant.
    """
    runner, steps = ActionRunner(order_by), []
    # Written once: the counts below and the result all start from it.
    current = stage(runner.run(df, Action("deduplicate", {"strategy": "exact"})).df, "cleaned")
    if current.count() < df.count():
        steps.append(Action("deduplicate", {"strategy": "exact"}))
    repair = Action("fix_formats", {"format_type": "auto"})
    repaired = runner.run(current, repair)
    if repaired.rows_affected:
        steps.append(repair)
        current = repaired.df
    texts = [f.name for f in df.schema.fields if is_text(f.dataType) and f.name not in leave_out]
    if texts:
        counted = distinct_counts(current.select(*[cols.col(c) for c in texts]), texts, whole_rows=False)
        holes = {c for c, n in null_counts(current, texts).items() if n}
        for c in texts:
            values = counted[c] + (c in holes)
            if counted[f"lower:{c}"] < (values if compatible else counted[c]):
                merge = Action("standardize", {"method": "cluster_merge"}, f"column:{c}")
                merged = runner.run(current, merge)
                if merged.rows_affected:
                    steps.append(merge)
                    current = merged.df
    fill = Action("fill_nulls", {"strategy": "mode"})
    filled = runner.run(current, fill)
    if filled.details["columns"]:
        steps.append(fill)
        current = filled.df
    return current, steps
