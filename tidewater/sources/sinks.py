"""Writers: documents, appended lines, idempotent merges, partitioned extracts."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.dedupe import new_keys, replace_days


def write_document(path: str, document: Any) -> None:
    """Replace a small JSON file at once: a temporary file beside it, then a rename. Keys are sorted."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(document, out, sort_keys=True, indent=1)
            out.write("\n")
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def append_rows(df: DataFrame, path: str) -> None:
    """Append JSON lines; files already there are never rewritten."""
    df.write.mode("append").json(path)


def _stored(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def merge_new(fresh: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Append only rows whose key is not stored; running it again adds nothing."""
    new_keys(_stored(fresh.sparkSession, path, fresh.schema), fresh, keys, order).write.mode("append").parquet(path)


def overwrite_days(fresh: DataFrame, path: str, since: int, day: str = "day") -> None:
    """Replace the days of ``fresh`` from ``since`` on; other days' files stay as they are."""
    fresh.filter(F.col(day) >= since).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged_days(stored: DataFrame, fresh: DataFrame, since: int, day: str = "day") -> DataFrame:
    return replace_days(stored, fresh, since, day)


def extract(rows: DataFrame, path: str, columns: Sequence[str], by: str = "identity") -> None:
    """Only the named columns, a folder an identity: rows meet by identity first, so that not every task has a file in every folder."""
    rows.select(by, *[c for c in columns if c != by]).hint("rebalance", by).write.mode("append").partitionBy(by).json(path)


def mark(df: DataFrame, key: str, value: Any, flag: str = "outlier") -> DataFrame:
    """Set a flag on the row with a key."""
    old = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
    return df.withColumn(flag, old | (F.col(key) == F.lit(value)))


def snapshot(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, columns, rows): each key's rows in order as arrays of values, for a JSON file that can be compared and frozen. A key's rows stay together."""
    row = F.array(*[F.col(c).cast("string") for c in columns])
    rows = F.transform(F.sort_array(F.collect_list(F.struct(*order, row.alias("_row")))), lambda x: x["_row"])
    return df.groupBy(by).agg(rows.alias("rows")).select(by, F.array(*map(F.lit, columns)).alias("columns"), "rows")
