"""Profiles, versions, actions, sources and plans on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from burnish.functions import scratch
from burnish.functions.ordering import with_row_index
from burnish.operators import columns as cols
from burnish.operators import ddl, relational
from burnish.operators import profile as prof
from burnish.plans import actions as act
from burnish.plans import versions
from burnish.plans.versions import VersionStore, row_changes, table_summary
from burnish.sources import tables as tbl
from burnish.sources.datasets import Datasets, alias_of
from burnish.sources.files import load
from burnish.sources.writers import export, insert_statements


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "Ana", "Lima", 10.0), (2, "Bob", "lima", 20.0), (3, None, "LIMA", 30.0), (4, "Dan", "Quito", None), (5, "Eve", "Bogota", 50.0),
         (5, "Eve", "Bogota", 50.0)],
        "id long, name string, city string, amount double",
    )


# -- profile --------------------------------------------------------------------------------

def test_profile_counts(people):
    p = prof.measure(people, "id")
    assert (p["row_count"], p["col_count"], p["duplicate_count"]) == (6, 4, 1)
    by = {c["name"]: c for c in p["columns"]}
    assert by["city"]["unique_count"] == 5 and by["name"]["null_count"] == 1 and by["name"]["unique_count"] == 5
    assert by["amount"]["min_value"] == "10.0" and by["amount"]["mean_value"] == 32.0
    assert by["city"]["sample_values"] == ["Lima", "lima", "LIMA", "Quito", "Bogota"]
    assert json.loads(prof.profile_json(people, "id"))["duplicateCount"] == 1


def test_positions_move_only_the_compared_columns(spark, monkeypatch):
    from burnish.functions import ordering
    from burnish.plans import versions

    a = spark.createDataFrame([(3, "x", 1, "long"), (1, "y", 2, "text"), (2, None, 3, "kept")], "k long, v string, w int, t string")
    b = spark.createDataFrame([(5, "y", 2, "other"), (6, "z", 4, "words"), (7, "x", None, "here"), (8, "q", 0, "more")], "k long, v string, w int, t string")
    written, stage = [], ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, label: written.append(df.columns) or stage(df, label))
    everything = {r.column_name: r for r in versions.diff_by_position(a, b, ["k"]).collect()}
    written.clear()
    some = versions.diff_by_position(a, b, ["k"], ["v", "w"]).collect()
    assert {r.column_name: r for r in some} == {c: everything[c] for c in ("v", "w")}
    assert all(set(names) <= {"v", "w", "__rank"} for names in written) and len(written) == 2


def test_columns_are_profiled_without_whole_rows(people, monkeypatch):
    seen = []
    count, repeats = prof.distinct_counts, prof.duplicate_count
    monkeypatch.setattr(prof, "distinct_counts", lambda *args: seen.append(found := count(*args)) or found)
    monkeypatch.setattr(prof, "duplicate_count", lambda df: seen.append({"*": 0}) or repeats(df))
    for approximate in (False, True):
        want = prof.measure(people, "id", approximate)["columns"]
        seen.clear()
        got = [r.asDict() for r in prof.profile_columns(people, "id", approximate).collect()]
        assert [{k: r[k] for k in ("name", "unique_count", "null_count", "issues")} for r in got] == [{k: c[k] for k in ("name", "unique_count", "null_count", "issues")} for c in want]
        assert not any("*" in found for found in seen)


def test_empty_table_scores_zero(spark):
    p = prof.measure(spark.createDataFrame([], "a long, b string"), "a")
    assert p["quality_score"] == 0 and p["row_count"] == 0


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    assert prof.duplicate_count(df).first()[0] == 1
    assert prof.distinct_counts(df)["*"] == 2
    few = prof.distinct_counts(df, whole_rows=False)
    assert "*" not in few and few == {c: n for c, n in prof.distinct_counts(df).items() if c != "*"}


def test_casing_issue(spark):
    df = spark.createDataFrame([(i, ["Lima", "LIMA", "Quito"][i % 3]) for i in range(120)], "id long, city string")
    assert any("casing" in i for c in prof.measure(df)["columns"] for i in c["issues"])


def test_date_layouts():
    assert prof.date_layouts(prof.fitting_patterns(["2024-01-02", "2024/01/02"])) == {"YYYY-MM-DD", "YYYY/MM/DD"}
    assert prof.date_layouts(prof.fitting_patterns(["01/02/2024"])) == {"DD/MM/YYYY"}
    assert prof.date_layouts(prof.fitting_patterns(["01/02/2024"]), strict=False) == {"DD/MM/YYYY", "MM/DD/YYYY"}
    assert prof.date_layouts(prof.fitting_patterns(["01/22/2024", "03/04/2024"])) == {"MM/DD/YYYY"}
    assert prof.date_layouts(prof.fitting_patterns(["01/22/2024", "22/01/2024"])) == {"DD/MM/YYYY", "MM/DD/YYYY"}


def test_estimates_are_close(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 50)
    by = {c["name"]: c["unique_count"] for c in prof.measure(df, approximate=True)["columns"]}
    assert abs(by["id"] - 5000) < 500 and abs(by["g"] - 50) < 5


def test_ddl(people):
    text = ddl.create_table(people, "people")
    assert '"id" BIGINT NOT NULL' in text and '"name" VARCHAR(255),' in text and text.startswith("CREATE TABLE people")
    assert "`amount` DOUBLE" in ddl.create_table(people, "people", "mysql")


# -- versions -------------------------------------------------------------------------------

def test_version_tree(spark, people, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), order_by="id")
    assert store.get_current() is None and store.undo() is None
    first = store.create_initial(people, 80)
    assert first.label == "v1 Original" and first.row_count == 6
    second = store.commit(people.where("id < 4"), "filter_rows", "kept three", 90, 3)
    store.undo()
    third = store.commit(people.drop("amount"), "drop_columns")
    assert third.parent_id == first.id and third.label == "v3 Drop Columns"
    store.undo()
    assert store.redo().count() == 3, "redo follows the oldest child"
    again = VersionStore(spark, str(tmp_path / "s"), order_by="id")
    assert again.current_id == second.id and [v.id for v in again.versions] == [first.id, second.id, third.id]
    assert again.get_version("nope") is None and again.delete_version("nope") is False
    for kept in (first.id, second.id):
        with pytest.raises(ValueError):
            again.delete_version(kept)
    assert again.delete_version(third.id) and len(again.versions) == 2
    assert again.compare(first.id, second.id).first().row_diff == -3
    assert [r.label for r in again.get_timeline().orderBy("position").collect()] == ["v1 Original", "v2 Filter Rows"]


def test_changes(people):
    changed = people.withColumn("city", F.when(F.col("id") == 1, "Cusco").otherwise(F.col("city")))
    assert {(r.id, r.change, r.copies) for r in row_changes(people, changed).collect()} == {(1, "removed", 1), (1, "added", 1)}
    s = table_summary(people, people.drop("city").withColumn("new", F.lit(1))).first()
    assert s.columns_added == ["new"] and s.columns_removed == ["city"] and s.row_diff == 0


# -- actions --------------------------------------------------------------------------------

def test_parse_actions():
    parsed = act.parse_actions('[{"type": "deduplicate"}, {"params": {}}, {"type": "x", "params": null, "target": "column:a"}]')
    assert [(a.type, a.params, a.target) for a in parsed] == [("deduplicate", {}, "all"), ("x", {}, "column:a")]
    assert parsed[1].column == "a"


def test_every_action_runs(spark, people, tmp_path):
    datasets = Datasets(spark)
    datasets.register("extra.csv", spark.createDataFrame([(1, "x")], "id long, tag string"))
    steps = [
        {"type": "deduplicate", "params": {"strategy": "exact"}},
        {"type": "standardize", "target": "column:city"},
        {"type": "fix_formats"},
        {"type": "fill_nulls", "params": {"strategy": "ml", "n_neighbors": 2}, "target": "column:amount"},
        {"type": "deduplicate_semantic", "params": {"subset": ["name", "city"]}},
        {"type": "remove_outliers", "params": {"column": "amount", "threshold": 3}},
        {"type": "profile"},
        {"type": "generate_sql"},
        {"type": "export", "params": {"format": "csv", "path": str(tmp_path / "out.csv")}},
        {"type": "filter_rows", "params": {"condition": "id < 5"}},
        {"type": "rename_column", "params": {"from": "amount", "to": "sum"}},
        {"type": "drop_columns", "params": {"columns": ["sum"]}},
        {"type": "merge", "params": {"right": "extra", "on": "id", "how": "left"}},
        {"type": "sort_by", "params": {"column": "id", "limit": 3}},
        {"type": "slice", "params": {"start": 0, "stop": 2}},
        {"type": "query", "params": {"sql": "SELECT city, tag FROM data"}},
        {"type": "aggregate", "params": {"by": "city"}},
    ]
    out = act.apply_actions(people, steps, "id", datasets)
    assert out.columns == ["city", "count_all"]
    assert load(spark, str(tmp_path / "out.csv")).count() == 5
    for bad in ({"type": "optimize"}, {"type": "join", "params": {"on": "id"}}, {"type": "join", "params": {"right": "no", "on": "id"}}):
        with pytest.raises((ValueError, KeyError)):
            act.apply_actions(people, [bad], "id", datasets)


def test_replay_gives_the_same_table(spark, people, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"))
    store.create_initial(people)
    act.run_and_commit(store, [{"type": "deduplicate"}, {"type": "fill_nulls", "params": {"strategy": "mean"}, "target": "column:amount"}])
    again = act.replay(people, store)
    assert sorted(map(str, again.collect())) == sorted(map(str, store.get_current().collect()))


def test_auto_clean(spark):
    rows = [(i, ["Lima", "lima ", "LIMA", "Quito"][i % 4], None if i == 7 else i % 3) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "id long, city string, n long")
    out, steps = act.auto_clean(df, order_by="id")
    got = out.collect()
    assert len(got) == 40 and {r.city for r in got} == {"Lima", "Quito"} or {r.city for r in got} == {"LIMA", "Quito"}
    assert all(r.n is not None for r in got)
    assert [s.type for s in steps] == ["deduplicate", "fix_formats", "standardize", "fill_nulls"]


# -- sources --------------------------------------------------------------------------------

def test_load_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        load(spark, "a.txt")
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "missing.csv"))


def test_csv_survives_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now'), (2, "two\nlines"), (3, None)], "id int, s string")
    export(df, str(tmp_path / "x.csv"), "csv")
    back = load(spark, str(tmp_path / "x.csv"), multi_line=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert load(spark, str(tmp_path / "x.csv"), n_rows=2).count() == 2
    (tmp_path / "y.tsv").write_text("a\td\n1\t2024-01-02\n")
    assert dict(load(spark, str(tmp_path / "y.tsv"), multi_line=True).dtypes) == {"a": "int", "d": "date"}


def test_insert_statements(spark):
    df = spark.createDataFrame([(1, "O'Hara", True), (2, None, None)], "id int, s string, b boolean")
    assert [r.statement for r in insert_statements(df, "t").orderBy("statement").collect()] == [
        'INSERT INTO t ("id", "s", "b") VALUES (1, \'O\'\'Hara\', true);',
        'INSERT INTO t ("id", "s", "b") VALUES (2, NULL, NULL);',
    ]


def test_dataset_names(spark, people):
    assert alias_of("my sales-2024.csv") == "my_sales_2024"
    ds = Datasets(spark)
    assert ds.register("a b.csv", people) == "a b.csv" and ds.register("a b.csv", people) == "a b_2.csv"
    assert spark.sql("SELECT * FROM a_b_2").count() == 6 and spark.sql("SELECT * FROM data").count() == 6
    assert ds.remove("a b_2.csv") and not ds.remove("a b_2.csv") and ds.active == "a b.csv"


class Recorder:
    """Stands in for a reader or writer and keeps what it is told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def mode(self, name):
        self.told["mode"] = name
        return self

    def option(self, key, value):
        self.told[key] = value
        return self

    def options(self, **more):
        self.told.update(more)
        return self

    def load(self):
        return self

    def save(self):
        return None


def test_jdbc_options():
    class Holder:
        read = Recorder()
        write = Recorder()

    where = tbl.Connection("jdbc:postgresql://db/x", {"user": "me", "numPartitions": "8"})
    tbl.read_table(Holder, "people", where, schema="public")
    assert Holder.read.told == {
        "format": "jdbc", "url": "jdbc:postgresql://db/x", "user": "me", "numPartitions": "8", "dbtable": "public.people"
    }
    tbl.read_query(Holder, "SELECT 1", where)
    assert Holder.read.told["query"] == "SELECT 1"
    for given, mode in {"replace": "overwrite", "append": "append", "fail": "errorifexists"}.items():
        tbl.write_table(Holder, "people", where, given)
        assert Holder.write.told["mode"] == mode
    with pytest.raises(ValueError):
        tbl.write_table(Holder, "people", where, "merge")


# -- order, scratch, streams, plans ---------------------------------------------------------

def test_row_index_is_dense(spark):
    df = spark.range(3000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.n for r in with_row_index(df, [F.col("k")], "n").orderBy("k").collect()]
    assert got == list(range(3000))


def test_deep_slice_equals_shallow(spark, monkeypatch):
    df = spark.range(500).repartition(5)
    shallow = relational.slice_rows(df, 100, 120, "id").collect()
    monkeypatch.setattr(relational, "SHALLOW_SLICE", 0)
    assert sorted(relational.slice_rows(df, 100, 120, "id").collect()) == sorted(shallow)


class Session:
    """A session as far as the scratch folder asks about it."""

    def __init__(self, master, folder=None):
        self.conf = {scratch.SETTING: folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"{master}-{folder}"


def test_scratch_follows_the_session(spark):
    assert scratch.scratch_root(Session("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session("yarn"))
    local = Session("local[2]")
    assert os.path.isdir(scratch.scratch_root(local)) and scratch.scratch_root(local) == scratch.scratch_root(local)
    assert scratch.stage(spark.range(3), "probe").count() == 3


def test_row_local_repairs_run_on_streams(spark, tmp_path):
    spark.createDataFrame([(1, " A@B "), (2, None)], "id long, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    steps = cols.fix_formats(cols.change_case(stream, "s", "lowercase").df, format_type="whitespace").df
    run = (
        steps.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination(60)
    assert {r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a@b", None}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    kept = plan(cols.filter_rows(lines, "l_quantity > 30").df.select("l_orderkey"))
    assert "GreaterThan(l_quantity,30.0)" in kept and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in kept
    assert "TakeOrderedAndProject" in plan(relational.sort_by(lines, "l_quantity", limit=5))
    from burnish.operators.dedup import first_rows

    assert "WindowGroupLimit" in plan(first_rows(lines, ["l_suppkey"], "l_orderkey"))
    joined = plan(relational.join_tables(lines, lines.select("l_orderkey", "l_tax"), "l_orderkey"))
    assert "CartesianProduct" not in joined and "NestedLoop" not in joined


# -- versions that share data ---------------------------------------------------------------

def stored(tmp_path) -> dict[str, set[str]]:
    """Sets of a store and the columns of each."""
    import pyarrow.dataset as ds

    return {p.name: set(ds.dataset(str(p), format="parquet").schema.names) for p in (tmp_path / "s" / "versions").iterdir()}


@pytest.mark.parametrize("order_by", [None, "id"])
def test_commits_write_only_what_changed(spark, people, tmp_path, monkeypatch, order_by):
    store = VersionStore(spark, str(tmp_path / "s"), order_by)
    first = store.create_initial(people)
    index = {"__row"} if order_by else set()
    seen = [set(stored(tmp_path))]
    steps = [
        ({"type": "rename_column", "params": {"from": "city", "to": "town"}}, None),
        ({"type": "drop_columns", "params": {"columns": ["name"]}}, None),
        ({"type": "fill_nulls", "params": {"strategy": "mean"}, "target": "column:amount"}, {"__id", "amount"}),
        ({"type": "filter_rows", "params": {"condition": "id > 1"}}, {"__id"} | index),
        ({"type": "fix_formats", "target": "column:town"}, {"__id", "town"}),
    ]
    plain, written = people, []
    for step, columns in steps:
        version = act.run_and_commit(store, [step], order_by)
        plain = act.apply_actions(plain, [step], order_by)
        got = store.get_current()
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        new = set(stored(tmp_path)) - seen[-1]
        seen.append(set(stored(tmp_path)))
        assert [stored(tmp_path)[n] for n in new] == ([columns] if columns else [])
        written.append(version)
    # Too many sets to read together: the version is whole again.
    monkeypatch.setattr(versions, "MOST_SETS", 2)
    last = act.run_and_commit(store, [{"type": "fill_nulls", "params": {"strategy": "zero"}, "target": "column:amount"}, {"type": "filter_rows", "params": {"condition": "id > 2"}}], order_by)
    assert len(last.sets) == 1 and store.get_current().count() == plain.where("id > 2").count()
    assert store.get_version(first.id).count() == people.count()
    for v in written[:-1]:
        store.delete_version(v.id)
    assert sorted(map(str, store.get_version(written[-1].id).collect())) == sorted(map(str, plain.collect()))


def test_counts_come_from_the_write(spark, people, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), "id")
    store.create_initial(people)
    steps = [
        {"type": "fill_nulls", "params": {"strategy": "zero"}, "target": "column:amount"},
        {"type": "fill_nulls", "params": {"strategy": "zero"}, "target": "column:amount"},
        {"type": "fix_formats", "target": "column:city"},
        {"type": "standardize", "params": {"method": "uppercase"}, "target": "column:city"},
        {"type": "filter_rows", "params": {"condition": "id < 4"}},
    ]
    plain = people
    for step in steps:
        outcome = act.ActionRunner("id").run(plain, act.parse_actions([step])[0])
        version = act.run_and_commit(store, [step], "id")
        assert (version.rows_affected, version.description) == (outcome.rows_affected, outcome.description)
        plain = outcome.df


def test_a_crash_before_the_log_leaves_the_old_version(spark, people, tmp_path, monkeypatch):
    store = VersionStore(spark, str(tmp_path / "s"))
    first = store.create_initial(people)

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_append", crash)
    with pytest.raises(RuntimeError):
        act.run_and_commit(store, [{"type": "filter_rows", "params": {"condition": "id < 3"}}])
    again = VersionStore(spark, str(tmp_path / "s"))
    assert [v.id for v in again.versions] == [first.id] and again.get_current().count() == people.count()


def test_diff_reads_only_columns_that_may_differ(spark, people, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), "id")
    first = store.create_initial(people)
    second = act.run_and_commit(store, [{"type": "fill_nulls", "params": {"strategy": "zero"}, "target": "column:amount"}], "id")
    found = store.diff(first.id, second.id)
    assert {r.column_name: (r.cells_changed_nulls > 0, r.rows_compared) for r in found.collect()} == {
        c: (c == "amount", people.count()) for c in people.columns
    }
    assert "name:string" not in found._jdf.queryExecution().executedPlan().toString()


def test_overlaps_equal_a_loop(spark):
    import random

    from burnish.operators.overlap import overlap_join

    rng = random.Random(4)
    spans = lambda n: [(i, s := rng.uniform(-50, 50), s + rng.choice([-1, 0, 0.5, 3, 40, 1000])) for i in range(n)] + [(n, None, 1.0), (n + 1, 2.0, None)]
    a, b = spans(60), spans(50)
    left = spark.createDataFrame(a, "i long, s double, e double")
    right = spark.createDataFrame(b, "j long, t double, f double")
    want = {(i, j) for i, s, e in a for j, t, f in b if None not in (s, e, t, f) and s <= e and t <= f and s <= f and t <= e}
    for width in (None, 0.1, 500.0):
        pairs = overlap_join(left, right, ("s", "e"), ("t", "f"), width)
        got = [(r.i, r.j) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert overlap_join(left.limit(0), right, ("s", "e"), ("t", "f")).count() == 0
    with pytest.raises(ValueError):
        overlap_join(left, left, ("s", "e"), ("s", "e"))


def test_overlaps_are_counted_without_their_pairs(spark):
    import random

    from burnish.operators import overlap

    rng = random.Random(5)
    spans = lambda n, keys: [(rng.choice([None, *range(keys)]), s := rng.randrange(12), s + rng.choice([-1, 0, 1, 2, 9])) for _ in range(n)] + [(1, None, 1), (2, 2, None)]
    for keys in (2, 6, 90):
        a, b = spans(70, keys), spans(60, keys)
        left, right = spark.createDataFrame(a, "i long, s int, e int"), spark.createDataFrame(b, "j long, t int, f int")
        found = {}
        for i, s, e in a:
            for j, t, f in b:
                if None not in (i, j, s, e, t, f) and i != j and s <= e and t <= f and s <= f and t <= e:
                    n, last = found.get(i, (0, j))
                    found[i] = (n + 1, max(last, j))
        got = overlap.overlap_summary(left, right, ("s", "e"), ("t", "f"), "i", "j")
        assert got.columns == ["i", "n", "last_key"]
        assert {r.i: (r.n, r.last_key) for r in got.collect()} == found
    # A thousand rows of one span are one row of the join.
    many, met = spark.range(1000).selectExpr("id as i", "3 as s", "4 as e"), []
    join = overlap.overlap_join
    with pytest.MonkeyPatch.context() as m:
        m.setattr(overlap, "overlap_join", lambda *args: met.append(out := join(*args)) or out)
        got = overlap.overlap_summary(many, many.selectExpr("i as j", "s as t", "e as f"), ("s", "e"), ("t", "f"), "i", "j")
        assert got.where("n = 999").count() == 1000 and met[0].count() == 1


@pytest.mark.parametrize("names", [["a"], ["b", "a"], ["d", "b", "a"]])
def test_deep_slices_by_selection(spark, monkeypatch, names):
    from burnish.operators import relational as rel

    monkeypatch.setattr(rel, "SHALLOW_SLICE", 5)
    monkeypatch.setattr(rel, "SELECTED_ROWS", 60)
    monkeypatch.setattr(rel, "SELECTED_SAMPLE", 200)
    df = spark.range(3000).selectExpr(
        "(id * 7919) % 3000 as a", "if(id % 5 = 0, null, cast(id % 7 as string)) as b", "if(id % 3 = 0, null, date_add(date'2020-01-01', cast(id % 11 as int))) as d"
    )
    everything = [tuple(r) for r in df.orderBy(*names).collect()]
    for start, stop in ((0, 30), (1490, 1500), (2990, 3100), (2000, 2400), (5000, 5010), (7, 7)):
        assert [tuple(r) for r in rel.slice_rows(df, start, stop, names).collect()] == everything[start:stop]
    assert "__place" not in rel.slice_rows(df, 1490, 1500, names)._jdf.queryExecution().optimizedPlan().toString()


# -- profiles that merge --------------------------------------------------------------------

EXACT = ["name", "dtype", "rows", "nulls", "least", "greatest", "bytes"]


def test_states_of_parts_merge(spark):
    from burnish.operators import profile_state as ps

    df = spark.range(20_000).selectExpr("id % 5000 as n", "if(id % 9 = 0, null, id * 1.5) as x", "if(id % 2 = 0, 'Aa', 'aA') || id % 301 as s", "array(id) as a")
    whole = {r.name: r for r in ps.column_states(df).collect()}
    merged = ps.merge_states(*(ps.column_states(df.where(f"pmod(hash(n, x, s), 3) = {k}")) for k in range(3)), ps.column_states(df.limit(0)))
    got = {r.name: r for r in merged.collect()}
    for c in df.columns:
        assert [got[c][f] for f in EXACT] == [whole[c][f] for f in EXACT]
        assert got[c].total == pytest.approx(whole[c].total) or whole[c].total is None
    said = {r.name: r for r in ps.describe_states(merged).collect()}
    assert said["n"].unique_estimate == pytest.approx(5000, rel=0.05) and said["s"].unique_estimate == pytest.approx(602, rel=0.05)
    assert said["s"].folded_estimate == pytest.approx(301, rel=0.05) and said["s"].median is None
    assert said["n"].median == pytest.approx(2500, abs=5000 * 0.05) and said["x"].third_quartile == pytest.approx(22_500, rel=0.05)
    assert said["x"].mean_value == pytest.approx(df.agg(F.avg(F.col("x").cast("double"))).first()[0]) and said["a"].null_count == 0


def test_versions_share_states(spark, people, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), "id")
    first = store.create_initial(people)
    count = lambda: spark.read.parquet(str(tmp_path / "s" / "profiles")).count()
    assert [r.name for r in store.profile_states(first.id).orderBy("ordinal").collect()] == people.columns and count() == 4
    second = act.run_and_commit(store, [{"type": "fill_nulls", "params": {"strategy": "zero"}, "target": "column:amount"}, {"type": "rename_column", "params": {"from": "city", "to": "town"}}], "id")
    states = {r.name: r.nulls for r in store.profile_states(second.id).collect()}
    assert count() == 5 and states == {"id": 0, "name": people.where("name is null").count(), "town": people.where("city is null").count(), "amount": 0}
    third = act.run_and_commit(store, [{"type": "filter_rows", "params": {"condition": "id < 3"}}], "id")
    assert {r.rows for r in store.profile_states(third.id).collect()} == {people.where("id < 3").count()} and count() == 9
