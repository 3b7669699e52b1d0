"""Where intermediate results go, and how a long lineage is cut.

Iterative operators write each round to a table in the shared folder that the cluster names in
``spark.checkpoint.dir`` and read it back. The table outlives lost executors, carries statistics
for the next plan, and lets columns be pruned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; only a local session may fall back to a temporary one."""
    configured = spark.conf.get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {SETTING} to a folder that every executor can reach.")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="burnish-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the frame once and continue from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Partition by keys for work that is heavy per row.

    The number of partitions is given, so that a few megabytes are not merged into one task.
    """
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    if rows > 1_000_000:
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)
