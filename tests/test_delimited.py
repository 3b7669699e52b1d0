"""Delimited text with line breaks in quotes, split among tasks."""

import random

import pytest

from burnish.sources.files import load
from burnish.sources.quoted import read_quoted
from burnish.sources.writers import export

SCHEMA = "a string, b string, c string"


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few bytes."""
    sizes = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rng) -> str:
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["", "1", "plain", "stray\"quote", " x ", "é漢", "it's"])
    body = "".join(rng.choices(["a", ",", "\n", '""', " ", "long word ", "é", '\n""\n', ",\n"], k=rng.randint(0, 12)))
    return f'"{body}"'


def rows_of(df) -> list:
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_as_whole_files(spark, small_ranges, tmp_path, seed, end):
    rng = random.Random(seed)
    for part in range(2):
        lines = ['a,"b",c', *(",".join(cell(rng) for _ in range(3)) for _ in range(40))]
        (tmp_path / f"part{part}.csv").write_bytes((end.join(lines) + end * (part == 0)).encode())
    mine = load(spark, f"{tmp_path}/*.csv", schema=SCHEMA)
    whole = load(spark, f"{tmp_path}/*.csv", schema=SCHEMA, multi_line=True)
    assert rows_of(mine) == rows_of(whole)
    assert spark.read.text(f"{tmp_path}/*.csv").rdd.getNumPartitions() > 20


def test_a_record_over_many_ranges(spark, small_ranges, tmp_path):
    text = "\n".join(f'line "" {i},' for i in range(200))
    (tmp_path / "x.csv").write_text(f'a,b,c\n1,"{text}",2\n"{text}",3,"4\n5"\n')
    want = text.replace('""', '"')
    assert rows_of(load(spark, f"{tmp_path}/x.csv", schema=SCHEMA)) == sorted([("1", want, "2"), (want, "3", "4\n5")])


def test_header_over_lines_and_ranges(spark, small_ranges, tmp_path):
    name = "first\n" + "long " * 30 + "\nname"
    (tmp_path / "x.csv").write_text(f'"{name}",b\n1,"x\ny"\n2.5,\n')
    df = load(spark, f"{tmp_path}/x.csv")
    assert df.columns == [name, "b"] and rows_of(df) == [(1.0, "x\ny"), (2.5, None)]


def test_types_with_and_without_breaks(spark, tmp_path):
    cells = "n,x,d,t,flag,s\n1,1.5,2024-01-02,2024-01-02 03:04:05,true,{}\n,2,,,,z\n3000000000,.5,2023-12-31,2024-01-02 00:00:00,false,\n"
    for name, text in (("flat", "a b"), ("broken", '"a\nb"')):
        (tmp_path / f"{name}.csv").write_text(cells.format(text))
    flat, broken = (load(spark, f"{tmp_path}/{n}.csv") for n in ("flat", "broken"))
    assert flat.schema == broken.schema
    assert [r for r in rows_of(flat) if r[5] != "a b"] == [r for r in rows_of(broken) if r[5] != "a\nb"]


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_round_trip_keeps_every_text(spark, tmp_path, fmt):
    texts = ["", None, " padded ", 'a "quoted" one', "two\nlines", "tab\tand,comma", '"', '\n"\n', "cr\r\nlf", "cr\rin it"]
    df = spark.createDataFrame([(i, t, "end") for i, t in enumerate(texts)], "a long, b string, c string")
    back = load(spark, export(df, f"{tmp_path}/out.{fmt}", fmt), schema=df.schema)
    assert rows_of(back) == rows_of(df)


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n")
    assert read_quoted(spark, f"{tmp_path}/x.csv").columns == ["a", "b"]
    (tmp_path / "y.csv").write_text('a,b\n"",\n\n"x\ny",\n')
    assert rows_of(load(spark, f"{tmp_path}/y.csv", schema="a string, b string")) == [("", None), ("x\ny", None)]
