"""Named datasets of a session, each visible to SQL under its file name and a plain alias."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from burnish.functions.types import quoted

# The extensions an alias drops.
ALIAS_EXTENSIONS = (".csv", ".parquet", ".json", ".xlsx")


def alias_of(name: str) -> str:
    """Dataset name as an identifier: no extension, '-' and ' ' as '_'."""
    for ext in ALIAS_EXTENSIONS:
        name = name.replace(ext, "")
    return name.replace("-", "_").replace(" ", "_")


class Datasets:
    """Registry of name -> DataFrame backed by temporary views; the active one is also ``data``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}
        self.active: str | None = None

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        for known, df in self._frames.items():
            if alias_of(known) == name:
                return df
        if name == "data" and self.active:
            return self._frames[self.active]
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return list(self._frames)

    def free_name(self, name: str) -> str:
        """The name itself, or stem_2.ext, stem_3.ext ... when it is taken."""
        stem, ext = os.path.splitext(name)
        candidate, i = name, 2
        aliases = {alias_of(n) for n in self._frames}
        while candidate in self._frames or alias_of(candidate) in aliases:
            candidate, i = f"{stem}_{i}{ext}", i + 1
        return candidate

    def register(self, name: str, df: DataFrame, activate: bool = True) -> str:
        """Add a dataset under a free name and return that name."""
        name = self.free_name(name)
        self.replace(name, df)
        if activate:
            self.activate(name)
        return name

    def replace(self, name: str, df: DataFrame) -> None:
        self._frames[name] = df
        for view in {name, alias_of(name)}:
            df.createOrReplaceTempView(quoted(view))
        if name == self.active:
            df.createOrReplaceTempView("data")

    def activate(self, name: str) -> None:
        self.active = name
        self._frames[name].createOrReplaceTempView("data")

    def remove(self, name: str) -> bool:
        if name not in self._frames:
            return False
        del self._frames[name]
        for view in {name, alias_of(name)}:
            self.spark.catalog.dropTempView(view)
        if self.active == name:
            self.active = None
            self.spark.catalog.dropTempView("data")
            if self._frames:
                self.activate(next(iter(self._frames)))
        return True


def run_query(df: DataFrame, query: str, table_name: str = "data") -> DataFrame:
    """Run SQL in which ``table_name`` is the given table; everything else is plain Spark SQL."""
    df.createOrReplaceTempView(quoted(table_name))
    return df.sparkSession.sql(query)
