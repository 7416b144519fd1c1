"""Published documents: nested sections assembled for each key, and rebuilt at a given instant.

A document is one JSON text a key with its sections' rows in order, so it is bounded by what one key
publishes. It depends on its rows and its instant only: two builds at one instant are equal byte by byte.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import sets


def assemble(sections: Mapping[str, DataFrame], by: str, now: Column) -> DataFrame:
    """(by, document): every section's rows as an array of objects, sorted by their columns from the left; a key without rows has an empty one.

    Columns of a section must be orderable; their order is the order in which rows are sorted and fields stand.
    """
    held = [df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias(name)) for name, df in sections.items()]
    whole = reduce(lambda a, b: a.join(b, by, "full_outer"), held)
    parts = [F.coalesce(F.col(name), F.array()).alias(name) for name in sections]
    return whole.select(by, F.to_json(F.struct(now.alias("generated_at"), F.col(by).alias("key"), *parts), {"ignoreNullFields": "false"}).alias("document"))


def rebuilt_diff(stored: DataFrame, rebuilt: DataFrame, by: str) -> DataFrame:
    """(id, path, old, new) of the leaves in which stored documents differ from rebuilt ones."""
    return sets.document_diff(sets.document_leaves(stored, by, "document"), sets.document_leaves(rebuilt, by, "document"))
