"""Set operations and comparisons of tables and documents."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefer(verified: DataFrame, everything: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verified rows, and others only for keys without a verified one."""
    return verified.unionByName(everything.join(verified.select(*keys).distinct(), list(keys), "left_anti"))


def in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose values differ: added, removed or changed."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), list(keys), "full_outer")
    kind = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "added").when(F.col("new").isNull() & F.col("old").isNotNull(), "removed")
    same = F.col("old").eqNullSafe(F.col("new"))
    if tolerance:
        same = same | F.coalesce(F.abs(F.col("old") - F.col("new")) <= tolerance, F.lit(False))
    return both.filter(~same).withColumn("kind", F.coalesce(kind, F.lit("changed")))


def leaves(document: Any, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, JSON scalar) of each leaf, keys in order; an empty container is a leaf."""
    if isinstance(document, dict) and document:
        for key in sorted(document):
            yield from leaves(document[key], f"{path}.{key}" if path else str(key))
    elif isinstance(document, list) and document:
        for i, item in enumerate(document):
            yield from leaves(item, f"{path}[{i}]")
    else:
        yield path, json.dumps(document, sort_keys=True)


def document_leaves(documents: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, value) of every leaf of JSON documents; text that is not JSON has none."""

    def run(batches):  # type: ignore[no-untyped-def]
        import pyarrow as pa

        for b in batches:
            ids, paths, values = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = list(leaves(json.loads(text))) if text else []
                except ValueError:
                    found = []
                ids += [key] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], ["id", "path", "value"])

    slim = documents.select(F.col(id_col).alias("id"), F.col(json_col).cast("string").alias("_json"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, path string, value string")


def document_diff(published: DataFrame, rebuilt: DataFrame, ignored: Sequence[str] = (), tolerance: float = 0.0) -> DataFrame:
    """Leaves that differ between two sets of (id, path, value). 1 equals 1.0; a boolean equals no number."""
    for prefix in ignored:
        published, rebuilt = (x.filter(~F.startswith(F.col("path"), F.lit(prefix))) for x in (published, rebuilt))
    both = published.withColumnRenamed("value", "old").join(rebuilt.withColumnRenamed("value", "new"), ["id", "path"], "full_outer")
    a, b = F.expr("try_cast(old AS double)"), F.expr("try_cast(new AS double)")
    same = F.col("old").eqNullSafe(F.col("new")) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return both.filter(~same)
