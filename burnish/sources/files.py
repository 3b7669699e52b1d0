"""File scans, chosen by extension."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from burnish.sources.quoted import read_quoted, reader_options


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Delimited text with a header. Types, dates among them, are inferred unless given.

    Line breaks within quotes are found by a scan of the files when this is called; files are split
    among tasks either way. ``multi_line=False`` says that there are none and spares the scan,
    ``True`` gives each file to one task. An empty cell is null, and empty text if it is quoted.
    """
    if multi_line is None:
        return read_quoted(spark, path, sep, schema)
    reader = spark.read.options(**reader_options(sep), multiLine=multi_line)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_json_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON document or array per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


READERS = {
    ".csv": read_delimited,
    ".tsv": partial(read_delimited, sep="\t"),
    ".json": read_json_document,
    ".jsonl": read_json_lines,
    ".ndjson": read_json_lines,
    ".parquet": read_parquet,
}


def load(
    spark: SparkSession,
    path: str,
    n_rows: int | None = None,
    schema: T.StructType | str | None = None,
    format: str | None = None,
    **options,
) -> DataFrame:
    """Scan a file, a folder or a glob; the extension (or ``format``) names the reader.

    Give ``schema`` for large delimited or JSON input: inference reads the data once more. Further
    options go to the reader (``multi_line`` for delimited text).
    """
    suffix = f".{format.lstrip('.')}" if format else os.path.splitext(path.rstrip("/*"))[1].lower()
    reader = READERS.get(suffix)
    if reader is None:
        raise ValueError(f"Unsupported file type: '{suffix}'. Supported: {', '.join(sorted(READERS))}")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path):
        raise FileNotFoundError(f"File not found: {path}")
    df = reader(spark, path, schema=schema, **options)
    return df.limit(n_rows) if n_rows is not None else df
