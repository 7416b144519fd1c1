"""Cutting lineage between rounds by tables in the folder that all executors share, and dealing out groups of much work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary folder stands in only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str, few: bool = False) -> DataFrame:
    """Rows dealt by key over a given number of tasks; ``few`` of them, four a core, where each task sends sums of its own.

    Adaptive execution joins small partitions by their bytes, and groups of few bytes may hold much work: a
    number that is asked for stays.
    """
    spark = df.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    return df.repartition(tasks if few else max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
