"""Analytic functions over neighbouring rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import DAY


def array_median(values: Column) -> Column:
    """Median of a short array: middle, or mean of the two middles; null when empty."""
    x, n = F.array_sort(values), F.size(values)
    low, high = F.try_element_at(x, F.floor((n + 1) / 2).cast("int")), F.try_element_at(x, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def clamped_median(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, width: int, name: str = "running_median") -> DataFrame:
    """Median of the ``width`` rows nearest in order; at the edges the frame is shifted, not cut, so it stays full.

    A frame of twice the width holds every shifted frame, so a key's rows are never gathered.
    """
    half = width // 2
    w = W.partitionBy(*by).orderBy(*order)
    place, n = F.row_number().over(w) - 1, F.count("*").over(W.partitionBy(*by))
    out = df.withColumns({"_i": place, "_n": n, "_near": F.collect_list(value).over(w.rowsBetween(-width, width))})
    first = F.greatest(F.lit(0), F.least(F.col("_i") - half, F.col("_n") - width))
    offset = first - F.greatest(F.lit(0), F.col("_i") - width)
    return out.withColumn(name, array_median(F.slice("_near", (offset + 1).cast("int"), width))).drop("_i", "_n", "_near")


def previous_median(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, width: int = 4, name: str = "previous_median") -> DataFrame:
    """Median of up to ``width`` rows before this one."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-width, -1)
    return df.withColumn(name, array_median(F.collect_list(value).over(w)))


def trailing_level(df: DataFrame, by: Sequence[str], day: str, num: str, den: str, days: int = 7, name: str = "level") -> DataFrame:
    """Pooled ratio over the last ``days`` days."""
    w = W.partitionBy(*by).orderBy(day).rangeBetween(-(days - 1), 0)
    return df.withColumn(name, F.try_divide(F.sum(num).over(w), F.sum(den).over(w)))


def local_noise(df: DataFrame, by: Sequence[str], day: str, num: str, den: str, half: int = 7) -> DataFrame:
    """Median squared deviation of each row from the level of the days around it, itself left out, scaled by its weight."""
    w = W.partitionBy(*by).orderBy(day).rangeBetween(-half, half)
    others = (F.sum(num).over(w) - F.col(num)) / F.nullif(F.sum(den).over(w) - F.col(den), F.lit(0))
    off = df.withColumn("_level", others).withColumn("_d", F.pow(F.col(num) - F.col("_level") * F.col(den), 2) / F.col(den))
    return off.filter("_d is not null").groupBy(*by).agg(F.median("_d").alias("noise"), F.count("*").alias("n"))


def relative_to_own(df: DataFrame, by: Sequence[str], num: str, den: str, name: str = "relative") -> DataFrame:
    """Ratio over the pooled ratio of the row's group."""
    w = W.partitionBy(*by)
    return df.withColumn(name, (F.col(num) / F.col(den)) / (F.sum(num).over(w) / F.sum(den).over(w)))


def demeaned(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.withColumn(f"{value}_centred", F.col(value) - F.avg(value).over(W.partitionBy(*by)))


def lag_correlation(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, least: int = 6) -> DataFrame:
    """Correlation of a series with itself one row on."""
    out = df.withColumn("_before", F.lag(value).over(W.partitionBy(*by).orderBy(*order)))
    return out.groupBy(*by).agg(F.corr("_before", value).alias("lag1"), F.count("*").alias("n")).filter(F.col("n") >= least)


def active_sets(spans: DataFrame, by: Sequence[str], member: str, start: str, end: str) -> DataFrame:
    """Maximal sets of members active together, an end counting before a start at one instant.

    A set is read at each start: the members whose span holds that instant. Sets within another are dropped.
    """
    starts = spans.select(*by, F.col(start).alias("_at")).distinct()
    held = starts.join(spans, list(by)).filter((F.col(start) <= F.col("_at")) & (F.col("_at") < F.col(end)))
    sets = held.groupBy(*by, "_at").agg(F.array_sort(F.collect_set(member)).alias("members")).select(*by, "members").distinct()
    other = sets.withColumnRenamed("members", "_other")
    wider = (F.size("_other") > F.size("members")) & (F.size(F.array_except("members", "_other")) == 0)
    bigger = sets.join(other, list(by)).filter(wider).select(*by, "members").distinct()
    return sets.join(bigger, [*by, "members"], "left_anti")


def day_units(df: DataFrame, by: Sequence[str], ts: str, at: int, values: Sequence[str], length: int = DAY) -> DataFrame:
    """Sums over units of ``length`` aligned at an instant, numbered from it."""
    return df.groupBy(*by, F.floor((F.col(ts) - at) / length).cast("bigint").alias("unit")).agg(*[F.sum(v).alias(v) for v in values])


def newest_each(df: DataFrame, by: Sequence[str], ts: str, unit: int, order: Sequence[str]) -> DataFrame:
    """The newest row of each key and time unit."""
    w = W.partitionBy(*by, F.floor(F.col(ts) / unit)).orderBy(F.desc(ts), *order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
