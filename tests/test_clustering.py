"""Greedy clustering against a plain loop; signatures and cells lose no pair."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burnish.functions import sequences
from burnish.functions import similarity as sim
from burnish.operators import batches, dedup, leaders, vectors


def ratio(a, b):
    """Similarity by the full table of common subsequence lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    total = len(a) + len(b)
    return 1.0 - (total - 2 * row[-1]) / total


def walk(items, similar):
    """The loop: item -> leader."""
    led, heads = {}, []
    for i, x in enumerate(items):
        lead = next((h for h in heads if similar(items[h], x)), None)
        led[i] = i if lead is None else lead
        if lead is None:
            heads.append(i)
    return led


@given(st.text("abcß ", max_size=12), st.text("abcß ", max_size=12))
def test_common_subsequence(a, b):
    assert sim._ratio(a, b) == pytest.approx(ratio(a, b))


NAMES = st.lists(st.text("abAé ", max_size=9), min_size=1, max_size=40)


def people(seed, n):
    """Names with misspellings, some repeated, some empty."""
    rng = np.random.default_rng(seed)
    base = ["john smith", "mary jones", "anna bell", "robert de niro", "li wei", ""]
    out = []
    for _ in range(n):
        s = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(s) + 1)
            if rng.random() < 0.5 and s:
                del s[min(at, len(s) - 1)]
            else:
                s.insert(at, "abcdefgh "[rng.integers(9)])
        out.append("".join(s))
    return out


def few_batches(monkeypatch, batch):
    """Batches of ``batch`` items. With 1 the first one is the last: signatures do the rest."""
    monkeypatch.setattr(batches, "BATCH", batch)
    if batch == 1:
        monkeypatch.setattr(batches, "FEW_OPEN", 0)
        monkeypatch.setattr(batches, "PAYS", 2.0)


@pytest.mark.parametrize(
    "threshold, first_heads, group_rows, batch",
    [(0.5, 64, 50_000, 2_048), (0.85, 64, 50_000, 1), (0.7, 2, 20, 1), (0.85, 2, 20, 1), (1.0, 64, 50_000, 25), (0.7, 64, 50_000, 9)],
)
def test_fuzzy_dedup_equals_loop(spark, monkeypatch, threshold, first_heads, group_rows, batch):
    # The third setting forces several rounds and chunked signatures, the last two several batches.
    few_batches(monkeypatch, batch)
    monkeypatch.setattr(leaders, "GROUP_ROWS", group_rows)
    make = dedup.text_matcher
    monkeypatch.setattr(
        dedup, "text_matcher", lambda v, t, n: leaders.Matcher(make(v, t, n).within, make(v, t, n).nearest, first_heads, 16_384)
    )
    names = people(int(threshold * 100), 120)
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    led = walk(names, lambda a, b: ratio(a, b) >= threshold)
    kept = {r.id for r in dedup.deduplicate(df, "fuzzy", ["name"], threshold, order_by="id").df.collect()}
    assert kept == {i for i, h in led.items() if i == h}
    matches = {(r.text, r.kept_text) for r in dedup.fuzzy_matches(df, ["name"], threshold, order_by="id").collect()}
    assert matches == {(names[i], names[h]) for i, h in led.items() if names[i] != names[h]}


def test_batches_go_on_where_leaders_are_few(spark, monkeypatch):
    # A batch of 32 has few leaders and claims little of the rest: signatures took over after the first.
    for name, value in (("BATCH", 32), ("FEW_OPEN", 50)):
        monkeypatch.setattr(batches, name, value)
    words = ["abcdefgh"[i // 8 % 8] * 4 + "abcdefgh"[i % 8] * 4 for i in range(64)]
    texts = [w + "0123456789"[i % 10] + "klmnopqrst"[i // 10] for w in words for i in range(40)]
    led = walk(texts, lambda a, b: ratio(a, b) >= 0.75)
    items = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id long, block string, text string")
    tile = lambda rows: sim.TextTile(rows.column("text").to_pylist(), rows.column("block").to_pylist(), 0.75)
    found, rest = batches.batch_leaders(items, tile, F.lit(10), True)
    assert rest is None
    assert {r.id: r.leader for r in found.collect()} == led
    tiles = tile(items.toArrow())
    short = batches.settle(tiles, len(texts), 3)
    assert len(set(short.tolist())) == 3 and short.tolist() == [led[i] for i in range(len(short))] and led[len(short)] == len(short)


def test_blocked_dedup_equals_loop(spark):
    names = people(5, 150)
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    led = walk(names, lambda a, b: (a[:2].lower() or "__") == (b[:2].lower() or "__") and ratio(a, b) >= 0.7)
    kept = {r.id for r in dedup.deduplicate(df, "fuzzy", ["name"], 0.7, order_by="id", block_by=["lower(substr(text, 1, 2))"]).df.collect()}
    assert kept == {i for i, h in led.items() if i == h}


TEXTS = st.lists(st.text("abé🧿", max_size=9) | st.text("abc", min_size=50, max_size=280), min_size=1, max_size=12)


@settings(max_examples=40, deadline=None)
@given(TEXTS, TEXTS, st.sampled_from([0.4, 0.75, 0.9]))
def test_texts_side_by_side(ones, others, threshold):
    """Bit vectors in lockstep give the lengths and decisions of single comparisons."""
    ones, others = ones + ["", "a" * 64, "ab" * 40], others + ["a" * 65, ""]
    pairs = [(a, b) for a in ones for b in others]
    common = [sequences.common_subsequence(a, b) for a, b in pairs]
    assert sequences.common_in_pairs([a for a, _ in pairs], [b for _, b in pairs]).tolist() == common
    left, right = (sim.TextTile(texts, [""] * len(texts), threshold) for texts in (ones, others))
    got = [hit for i in range(len(ones)) for hit in right.similar(left, i, np.arange(len(others))).tolist()]
    assert got == [sim._ratio(a, b) >= threshold for a, b in pairs]


@settings(max_examples=4, deadline=None)
@given(NAMES)
def test_signatures_keep_every_pair(spark, names):
    names = list(dict.fromkeys(names))
    df = spark.createDataFrame([(i, "", n) for i, n in enumerate(names)], "id long, block string, text string")
    for t in (0.6, 0.75, 0.9):
        sigs = {r.id: set(r.signatures) for r in sim.text_signatures(df, t).collect()}
        pairs = [(i, j) for i in range(len(names)) for j in range(i) if ratio(names[i], names[j]) >= t]
        assert all(sigs[i] & sigs[j] for i, j in pairs)


def test_prefilter_keeps_every_pair(spark):
    names = people(3, 60)
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").distinct()
    for t in (0.55, 0.8, 0.85):
        rows = df.withColumn("may", sim.may_be_similar(F.col("a"), F.col("b"), t)).collect()
        assert all(r.may for r in rows if ratio(r.a, r.b) >= t)


def crowd(seed, n, dim=6):
    """Unit vectors, a third of them close to one point."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim))
    rows[: n // 3] = rows[0] + 0.05 * rng.normal(size=(n // 3, dim))
    rng.shuffle(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize(
    "threshold, cell_rows, group_rows, heads, batch", [(0.92, 5_000, 50_000, 1_024, 2_048), (0.6, 20, 15, 8, 1), (0.92, 20, 15, 8, 1), (0.92, 20, 15, 8, 40)]
)
def test_semantic_dedup_equals_loop(spark, monkeypatch, threshold, cell_rows, group_rows, heads, batch):
    few_batches(monkeypatch, batch)
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(leaders, "GROUP_ROWS", group_rows)
    make = dedup.vector_matcher
    monkeypatch.setattr(dedup, "vector_matcher", lambda t: leaders.Matcher(make(t).within, make(t).nearest, heads, 32))
    rows = crowd(7, 150)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")
    led = walk(list(rows), lambda a, b: a @ b >= threshold)
    out = dedup.deduplicate_semantic(df, threshold=threshold, order_by="id", embedding="v")
    assert {r.id for r in out.df.collect()} == {i for i, h in led.items() if i == h}
    assert out.rows_affected == sum(i != h for i, h in led.items())
    matches = {(r.removed.o0, r.kept.o0) for r in dedup.semantic_matches(df, threshold=threshold, order_by="id", embedding="v").collect()}
    assert matches == {(i, h) for i, h in led.items() if i != h}


def test_cells_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    rows = crowd(11, 120)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vector array<double>")
    cells = {r.id: set(r.signatures) for r in vectors.vector_items(df, 0.9).collect()}
    assert len({c for s in cells.values() for c in s}) > 5
    assert all(cells[i] & cells[j] for i in range(120) for j in range(i) if rows[i] @ rows[j] >= 0.9)


def test_no_cells_where_they_do_not_pay(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    rows = np.random.default_rng(0).normal(size=(200, 64))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vector array<double>")
    assert {tuple(r.signatures) for r in vectors.vector_items(df, 0.3).collect()} == {(0,)}


def test_embedding_hook(spark):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def first_letters(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [float(t.count(c)) for c in "abc"])

    df = spark.createDataFrame([(1, "aab"), (2, "baa"), (3, "ccc")], "id long, t string")
    out = dedup.deduplicate_semantic(df, ["t"], order_by="id", embed=first_letters)
    assert sorted(r.id for r in out.df.collect()) == [1, 3]


def test_merge_spellings_equals_loop(spark):
    names = people(9, 200) + [n.upper() for n in people(9, 60)]
    df = spark.createDataFrame([(i, n or None) for i, n in enumerate(names)], "id long, name string")
    counts = {}
    for n in names:
        if n:
            counts[n] = counts.get(n, 0) + 1
    values = sorted(counts, key=lambda v: (-counts[v], v))
    led = walk(values, lambda a, b: ratio(a.lower(), b.lower()) >= 0.8)
    wanted = {v: values[led[i]] for i, v in enumerate(values)}
    out = dedup.standardize(df, "name")
    assert {(r.id, r.name) for r in out.df.collect()} == {(i, wanted.get(n)) for i, n in enumerate(names)}
    assert out.rows_affected == sum(wanted[n] != n for n in names if n)


def test_near_duplicate_people(spark):
    df = spark.createDataFrame(
        [(0, "John Smith", "NY"), (1, "Jon Smith", "NY"), (2, "John Smyth", "NY"), (3, "Maria Garcia", "LA"), (4, "Bob Lee", "SF")],
        "id long, name string, city string",
    )
    out = dedup.deduplicate(df, "fuzzy", ["name", "city"], 0.85, order_by="id")
    assert sorted(r.id for r in out.df.collect()) == [0, 3, 4]
    assert out.rows_affected == 2
    with pytest.raises(ValueError):
        dedup.deduplicate(df, "fuzzy", ["name"])
    with pytest.raises(ValueError):
        dedup.deduplicate(df, "phonetic")


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a long, b double")
    assert dedup.deduplicate(df, "fuzzy", order_by="a").df.count() == 2
    out = dedup.deduplicate_semantic(df, order_by="a")
    assert out.details["reason"] == "no_text_columns" and out.rows_affected == 0
