"""Aggregations: ratios of sums, robust medians, weighted medians, log-bin histograms, carried levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import DAY, rounding_error


def ratio_of_sums(df: DataFrame, by: Sequence[str], num: str, den: str, name: str = "ratio") -> DataFrame:
    """sum / sum, null where the divisor is not positive; never a mean of ratios."""
    out = df.groupBy(*by).agg(F.sum(num).alias(num), F.sum(den).alias(den), F.count("*").alias("points"))
    return out.withColumn(name, F.when(F.col(den) > 0, F.col(num) / F.col(den)))


def pooled_level(df: DataFrame, by: Sequence[str], num: str = "d5", den: str = "d7", pieces: str = "pieces", dispersion: float = 1.0) -> DataFrame:
    """Pooled ratio with its rounding interval."""
    out = df.groupBy(*by).agg(F.sum(num).alias(num), F.sum(den).alias(den), F.sum(pieces).alias(pieces), F.count("*").alias("points"))
    e = rounding_error(F.col(pieces), dispersion)
    return out.withColumns({"level": F.when(F.col(den) > 0, F.col(num) / F.col(den)), "lo": F.greatest(F.lit(0.0), F.col(num) - e) / (F.col(den) + e), "hi": F.when(F.col(den) > e, (F.col(num) + e) / (F.col(den) - e))})


def residual(df: DataFrame, by: Sequence[str], num: str = "d5", den: str = "d7") -> DataFrame:
    """sum |num - level x den| around the pooled level of each group."""
    w = W.partitionBy(*by)
    level = F.sum(num).over(w) / F.nullif(F.sum(den).over(w), F.lit(0))
    return df.withColumn("_off", F.abs(F.col(num) - F.coalesce(level, F.lit(0)) * F.col(den))).groupBy(*by).agg(F.sum("_off").alias("residual"))


def meeting_pieces(df: DataFrame, by: Sequence[str], start: str, end: str, windows: str) -> DataFrame:
    """sum(windows) less the neighbours that meet exactly, which share a rounding error."""
    meets = F.lag(end).over(W.partitionBy(*by).orderBy(start, end)) == F.col(start)
    return df.withColumn("_meets", F.coalesce(meets, F.lit(False))).groupBy(*by).agg((F.sum(windows) - F.count_if("_meets")).alias("pieces"))


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, median, half-range, 1.4826 MAD, and standard deviation, the last three relative."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_m"))
    joined = df.join(middle, list(by)) if by else df.crossJoin(F.broadcast(middle))
    out = joined.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad"), F.stddev_samp(value).alias("_sd"), F.avg(value).alias("_mean"))
    return out.select(*by, "n", "median", ((F.col("_hi") - F.col("_lo")) / 2 / F.col("median")).alias("half_range_rel"), (1.4826 * F.col("_mad") / F.col("median")).alias("mad_rel"), (F.col("_sd") / F.col("_mean")).alias("cv"))


def quartile_spread(value: Column) -> Column:
    """(Q3 - Q1) / median by linear interpolation; null for fewer than two values or a median of 0."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.when((F.count(value) >= 2) & (q[1] != 0), (q[2] - q[0]) / q[1])


def index_quantiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, median, and the values at ranks n // 4 and 3n // 4 (not interpolated), by rank, not by list."""
    w = W.partitionBy(*by).orderBy(value)
    ranked = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    at = lambda i: F.max(F.when(F.col("_i") == F.floor(i), F.col(value)))
    n = F.col("_n")
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), F.median(value).alias("median"), at(n / 4).alias("p25"), at(3 * n / 4).alias("p75"), F.min(value).alias("min"), F.max(value).alias("max"))


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, midpoint: bool = True) -> DataFrame:
    """First value with more than half of the weight below or at it; with ``midpoint``, halfway to the next at exactly half."""
    merged = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    up = W.partitionBy(*by).orderBy(value)
    both = merged.withColumns({"_cum": F.sum("_w").over(up.rowsBetween(W.unboundedPreceding, W.currentRow)), "_all": F.sum("_w").over(W.partitionBy(*by)), "_next": F.lead(value).over(up)})
    half = 2 * F.col("_cum")
    if not midpoint:
        return both.filter(half >= F.col("_all")).groupBy(*by).agg(F.min(value).alias("weighted_median"))
    picked = F.when(half == F.col("_all"), (F.col(value) + F.coalesce("_next", value)) / 2).otherwise(F.col(value))
    return both.filter(half >= F.col("_all")).groupBy(*by).agg(F.min_by(picked, value).alias("weighted_median"))


def daily_with_carry(df: DataFrame, by: Sequence[str], day: str, value: str, least: int) -> DataFrame:
    """Median of each day with at least ``least`` rows; other days to the last one carry the newest, flagged."""
    days = df.groupBy(*by, day).agg(F.median(value).alias("_median"), F.count("*").alias("n"))
    days = days.withColumn("_level", F.when(F.col("n") >= least, F.col("_median")))
    ends = days.groupBy(*by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    calendar = ends.withColumn(day, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    w = W.partitionBy(*by).orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = calendar.join(days, [*by, day], "left").withColumn("level", F.last("_level", True).over(w))
    return out.filter("level is not null").select(*by, day, "level", F.coalesce("n", F.lit(0)).alias("n"), F.col("_level").isNull().alias("interpolated"))


# --- log-bin histograms: a mergeable sketch kept as rows (key, bin, n) --------------------------


def histogram(df: DataFrame, by: Sequence[str], value: Column, ratio: float = 1.02) -> DataFrame:
    return df.filter(value > 0).groupBy(*by, F.floor(F.log(value) / F.log(F.lit(ratio))).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def merged_histograms(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def histogram_map(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """A histogram's bins as one map a key, for documents; bins are bounded by the range of doubles."""
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string").alias("k"), F.col("n").alias("v"))))).alias("hist"))


def histogram_quantiles(rows: DataFrame, by: Sequence[str], quantiles: Mapping[str, float], ratio: float = 1.02, least: int = 1) -> DataFrame:
    """Quantiles of a log-bin histogram, geometric inside a bin: ratio ** (bin + (rank - before) / n)."""
    up = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = rows.withColumns({"_cum": F.sum("n").over(up), "_all": F.sum("n").over(W.partitionBy(*by))})
    out = []
    for name, q in quantiles.items():
        rank = q * F.col("_all")
        at = F.pow(F.lit(ratio), F.col("bin") + (rank - (F.col("_cum") - F.col("n"))) / F.col("n"))
        out.append(F.min_by(F.when(F.col("_cum") >= rank, at), F.when(F.col("_cum") >= rank, F.col("bin"))).alias(name))
    return cum.groupBy(*by).agg(F.max("_all").alias("n"), *out).filter(F.col("n") >= least)


# --- regimes and weeks -----------------------------------------------------------------------------


def by_regime(df: DataFrame, changes: Sequence[int], at: str, strict: bool = False) -> DataFrame:
    """Number of changes at or before (``strict``: before) the row. The list of changes is short by nature."""
    cuts = F.array(*[F.lit(c).cast("bigint") for c in changes]) if changes else F.array().cast("array<bigint>")
    t = F.col(at)
    return df.withColumn("regime", F.size(F.filter(cuts, lambda c: (t > c) if strict else (t >= c))))


def chained_back(levels: DataFrame, by: Sequence[str], order: str, size: str, level: str) -> DataFrame:
    """Newest level kept; each earlier one is the next divided by the step between them (a reverse running product)."""
    later = W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    newest = F.max_by(level, order).over(W.partitionBy(*by))
    return levels.withColumn("chained", newest / F.exp(F.coalesce(F.sum(F.log(F.col(size))).over(later), F.lit(0.0))))


def recent(df: DataFrame, ts: str, now: int, days: int) -> DataFrame:
    return df.filter((F.col(ts) > now - days * DAY) & (F.col(ts) <= now))


def two_sides(df: DataFrame, by: Sequence[str], day: str, at: int, value: str, length: int = 14) -> DataFrame:
    """Ratio of the medians of the days after ``at`` and before it, ``length`` days a side."""
    d = F.col(day)
    before = F.median(F.when((d < at) & (d >= at - length), F.col(value)))
    after = F.median(F.when((d >= at) & (d < at + length), F.col(value)))
    return df.groupBy(*by).agg(before.alias("before"), after.alias("after")).withColumn("ratio", F.try_divide("after", "before"))


def pooled_minmax(df: DataFrame, by: Sequence[str], unit: str, value: str) -> DataFrame:
    """Median over all rows, and the union of each unit's range of medians."""
    units = df.groupBy(*by, unit).agg(F.median(value).alias("_m"))
    ends = units.groupBy(*by).agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"), F.count("*").alias("units"))
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.count("*").alias("n")).join(ends, list(by))


def median_of_medians(df: DataFrame, by: Sequence[str], unit: str, value: str) -> DataFrame:
    """Median over units of each unit's own median, the units' spread, and the rows behind it."""
    units = df.groupBy(*by, unit).agg(F.median(value).alias("_m"), F.count("*").alias("_n"))
    return units.groupBy(*by).agg(F.median("_m").alias("median"), quartile_spread(F.col("_m")).alias("spread"), F.count("*").alias("units"), F.sum("_n").alias("n"))


def fell(before: DataFrame, now: DataFrame, keys: Sequence[str], value: str, share: float, least: int) -> DataFrame:
    """Keys whose value fell by at least a share and an amount, counting vanished ones as 0."""
    both = before.select(*keys, F.col(value).alias("was")).join(now.select(*keys, F.col(value).alias("is")), list(keys), "full_outer").na.fill(0, ["was", "is"])
    lost = F.col("was") - F.col("is")
    return both.filter((lost >= share * F.col("was")) & (lost >= least))
