"""Deduplication with a stated winner, and merges of sources and stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first in a total order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def turns_from_lines(lines: DataFrame, counters: Sequence[str], key: str = "message_id", file: str = "file", file_order: str = "file_ord", line: str = "line_no", first: Sequence[str] = ("ts_us", "model"), flags: Sequence[str] = ()) -> DataFrame:
    """One row a message: a file's first line names it, its counters are the largest over that file's lines; the first file wins.

    Two steps, as counters of a later file must not raise those of the first.
    """
    per_file = lines.groupBy(key, file, file_order).agg(*[F.min_by(c, line).alias(c) for c in first], *[F.max(F.coalesce(c, F.lit(0))).alias(c) for c in counters], *[F.bool_or(f).alias(f) for f in flags], F.min(line).alias(line))
    return first_by(per_file, [key], [file_order, file])


def by_source_priority(rows: DataFrame, key: str, order: Sequence[str], source: str, until: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, count of what each source added): each key from its first source; the cut applies after the choice."""
    kept = first_by(rows, [key], list(order))
    if until is not None:
        kept = kept.filter(until)
    return kept, kept.groupBy(source).agg(F.count("*").alias("added"))


def one_a_minute(readings: DataFrame, by: Sequence[str] = ("account",), ts: str = "ts_us", reset: str = "resets_us", priority: str = "priority", seq: str = "seq") -> DataFrame:
    """One reading a minute: one that names its reset, then the source's priority, then the earliest."""
    return first_by(readings, [*by, F.floor(F.col(ts) / 60_000_000)], [F.col(reset).isNull(), priority, ts, seq])


def new_keys(existing: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fresh rows whose key is stored nowhere, each key once."""
    return first_by(fresh, list(keys), list(order)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def replace_days(stored: DataFrame, fresh: DataFrame, since: int, day: str = "day") -> DataFrame:
    """Stored rows before ``since``, and of later days without a fresh row; fresh rows of the rest."""
    new = fresh.filter(F.col(day) >= since)
    old = stored.filter(F.col(day) < since).unionByName(stored.filter(F.col(day) >= since).join(new.select(day).distinct(), day, "left_anti"))
    return old.unionByName(new)


def fill_models(stored: DataFrame, fresh: DataFrame, models: Sequence[str], model: str = "model") -> DataFrame:
    """All stored rows, and fresh rows of the named models only."""
    return stored.unionByName(fresh.filter(F.col(model).isin(*models)))


def keep_older(stored: DataFrame, fresh: DataFrame, day: str = "day") -> DataFrame:
    """Stored days older than every fresh one, then the fresh ones."""
    horizon = fresh.agg(F.min(day).alias("_horizon"))
    return stored.join(F.broadcast(horizon), F.col("_horizon").isNull() | (F.col(day) < F.col("_horizon"))).drop("_horizon").unionByName(fresh)


def first_table_wins(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of a, and of b what has no key in a."""
    return a.unionByName(b.join(a.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def update_by_method(stored: DataFrame, fresh: DataFrame, by: Sequence[str], day: str, method: str, current: str, days: int = 2) -> DataFrame:
    """Stored rows of the current method but for their last ``days``, which fresh rows replace; fresh rows alone where any stored row has another method."""
    since = stored.groupBy(*by).agg(F.when(F.bool_and(F.col(method) == current), F.max(day) - days + 1).alias("_since"))
    old = stored.join(since, list(by)).filter(F.col(day) < F.col("_since"))
    new = fresh.join(since, list(by), "left").filter(F.col("_since").isNull() | (F.col(day) >= F.col("_since")))
    return old.unionByName(new).drop("_since")
