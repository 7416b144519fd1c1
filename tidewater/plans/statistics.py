"""Fits, intervals, change-points and checks over the meter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import checks
from tidewater.functions.values import DAY, HOUR
from tidewater.operators import ordered, rollup
from tidewater.plans.base import MAX_GAP, events, query, readings, table
from tidewater.plans.metering import POINTS, VALUED, stretch_values, usd_per_pct_daily
from tidewater.plans.relational import DAILY, daily, family_design
from tidewater.stats import changes, fits


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity * l_quantity) AS aa, sum(l_linenumber * l_linenumber)::DOUBLE AS bb, sum(l_quantity * l_linenumber) AS ab, sum(l_quantity * (l_linenumber + l_quantity * 2)) AS ay, sum(l_linenumber * (l_linenumber + l_quantity * 2)) AS by_, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, n, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ka, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS kb, ((by_ * aa - ay * ab) / (aa * bb - ab * ab)) / ((ay * bb - by_ * ab) / (aa * bb - ab * ab)) AS weight FROM s""", ["STAT-41", "STAT-42"], views=False)
def output_weight_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-variable least squares from sums of products; whole numbers, so sums are exact."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.col("l_linenumber").cast("double").alias("b"), (F.col("l_linenumber") + F.col("l_quantity") * 2).alias("y"))  # noqa: E741
    return fits.two_variable_ls(l, ["l_returnflag"], "y", "l_quantity", "b")


@query(DAILY + """, v AS (SELECT account, day % 3 AS grp, round(ln(num::DOUBLE / den), 6) AS x, den::DOUBLE / 1000 AS w FROM d)
SELECT account, count(*) AS n, sum(2)::BIGINT AS df, round(sum(w * x) / sum(w), 9) AS mean, round(1 / sqrt(sum(w)), 9) AS se FROM v GROUP BY account""", ["STAT-29", "STAT-30", "STAT-33"])
def inverse_variance_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumns({"x": F.round(F.log(F.col("num") / F.col("den")), 6), "var": 1000 / F.col("den"), "df_": F.lit(2)})
    out = fits.inverse_variance(d, ["account"], "x", "var", "df_")
    return out.select("account", "n", "df", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@query(POINTS + ", i AS (SELECT account, d5 / (d7 + 2) AS lo, (d5 + 2) / greatest(d7 - 2, 0.5) AS hi FROM points WHERE d5 > 0) SELECT account, max(lo) AS max_lo, min(hi) AS min_hi, count(*) AS n, max(lo) <= min(hi) AS agree FROM i GROUP BY account", ["STAT-48", "STAT-47", "FLT-26", "FLT-27"])
def interval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ordered.window_points(readings(spark, sf_dir), MAX_GAP).filter("d5 > 0")
    p = p.withColumns({"lo": F.col("d5") / (F.col("d7") + 2), "hi": (F.col("d5") + 2) / F.greatest(F.col("d7") - 2, F.lit(0.5))})
    return fits.intervals_agree(p, ["account"], "lo", "hi")


@query(POINTS + """, l AS (SELECT account, sum(d5) AS d5, sum(d7) AS d7, sum(pieces)::BIGINT AS pieces, count(*) AS points FROM points GROUP BY account)
SELECT account, d5, d7, pieces, points, d5 / d7 AS level, greatest(0, d5 - 2 * sqrt(3.7::DOUBLE * pieces / 6)) / (d7 + 2 * sqrt(3.7::DOUBLE * pieces / 6)) AS lo, CASE WHEN d7 > 2 * sqrt(3.7::DOUBLE * pieces / 6) THEN (d5 + 2 * sqrt(3.7::DOUBLE * pieces / 6)) / (d7 - 2 * sqrt(3.7::DOUBLE * pieces / 6)) END AS hi FROM l""", ["AGG-13", "AGG-14", "STAT-4"])
def pooled_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pooled_level(ordered.window_points(readings(spark, sf_dir), MAX_GAP), ["account"], dispersion=3.7)


@query(POINTS + ", l AS (SELECT *, coalesce(sum(d5) OVER (PARTITION BY account) / nullif(sum(d7) OVER (PARTITION BY account), 0), 0) AS level FROM points) SELECT account, round(sum(abs(d5 - level * d7)), 6) AS residual FROM l GROUP BY account", ["AGG-15"])
def pooled_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.residual(ordered.window_points(readings(spark, sf_dir), MAX_GAP), ["account"])
    return out.withColumn("residual", F.round("residual", 6))


@query(VALUED + """, r AS (SELECT account, ln(nano / 1e11 / delta_pct) AS x, windows / (6 * delta_pct * delta_pct) AS v FROM stretch_values WHERE nano > 0)
SELECT account, round(pow(1.4826::DOUBLE * median(abs(x)), 2), 9) AS variance, count(*) AS n FROM r GROUP BY account""", ["STAT-27", "PRJ-45"])
def robust_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir).filter("nano > 0").withColumn("x", F.log(F.col("nano") / F.lit(1e11) / F.col("delta_pct")))
    return fits.robust_variance(s, ["account"], "x").withColumn("variance", F.round("variance", 9))


@query(VALUED + """, r AS (SELECT ln(nano / 1e11 / delta_pct) AS x, windows / (6 * delta_pct * delta_pct) AS v FROM stretch_values WHERE nano > 0)
SELECT (v >= 0)::INT + (v >= 0.0005)::INT + (v >= 0.001)::INT + (v >= 0.002)::INT AS bucket, count(*) AS n, round(var_samp(x), 6) AS observed, round(avg(v), 9) AS predicted FROM r GROUP BY ALL""", ["AGG-54"])
def rounding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir).filter("nano > 0").withColumns({"x": F.log(F.col("nano") / F.lit(1e11) / F.col("delta_pct")), "v": F.col("windows") / (6 * F.col("delta_pct") * F.col("delta_pct"))})
    out = fits.rounding_table(s, "x", "v", [0, 0.0005, 0.001, 0.002])
    return out.select("bucket", "n", F.round("observed", 6).alias("observed"), F.round("predicted", 9).alias("predicted"))


@query(DAILY + ", c AS (SELECT num - avg(num) OVER (PARTITION BY account) AS y, den - avg(den) OVER (PARTITION BY account) AS x FROM d) SELECT count(*) AS n, round(pow(corr(x, y), 2), 6) AS r_squared FROM c", ["STAT-58", "WIN-9"])
def within_r_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.within_r_squared(daily(spark, sf_dir), ["account"], "num", "den").select("n", F.round("r_squared", 6).alias("r_squared"))


@query(""", g AS (SELECT exp(-1 + 0.25 * i) AS w1, exp(-1 + 0.25 * j) AS w2 FROM range(9) a(i), range(9) b(j)),
r AS (SELECT y, 1 + n::DOUBLE AS base, c AS f, p AS s FROM (SELECT account, ts_us // 86400000000 AS day, sum(cents) / 100.0 AS y, count(*) AS n, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS c, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS p FROM e GROUP BY ALL)),
c AS (SELECT w1, w2, sum(1.0::DOUBLE) AS w, sum(ln(y / (base + w1 * f + w2 * s))) AS s, sum(pow(ln(y / (base + w1 * f + w2 * s)), 2)) AS q FROM r, g GROUP BY ALL)
SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(q - s * s / w, 4) AS ss FROM c""", [])
def two_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss over a grid of two weights, on each account's days."""
    of = lambda kind: F.count_if(F.col("event_type") == kind).cast("double")
    d = events(spark, sf_dir).groupBy("account", F.floor(F.col("ts_us") / DAY).alias("day")).agg((F.sum("cents") / 100.0).alias("y"), (1 + F.count("*")).cast("double").alias("base"), of("click").alias("c"), of("purchase").alias("p"), F.lit(1.0).alias("w"))
    out = fits.two_weight_grid(d, "y", "base", "c", "p", "w", 9, 1.0)
    return out.select(F.round("w1", 6).alias("w1"), F.round("w2", 6).alias("w2"), F.round("ss", 4).alias("ss"))


# --- kernels, drawn values and segmentation: tested against brute force ------------------------


def stretch_rates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir).filter("nano > 0")
    return s.withColumns({"rate": F.col("nano") / F.lit(1e11) / F.col("delta_pct"), "variance": F.col("windows") / (6 * F.col("delta_pct") * F.col("delta_pct"))})


@query(None, ["STAT-26"])
def huber_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.huber_location(stretch_rates_of(spark, sf_dir), ["account"], "rate", "variance")


@query(None, ["STAT-28", "STAT-32", "STAT-33"])
def log_ratio_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step at one instant: Huber log level after over before, per account, with a t interval."""
    s = stretch_rates_of(spark, sf_dir).withColumn("side", F.when(F.col("end_us") <= 1705276800000000, "before").when(F.col("start_us") >= 1705276800000000, "after")).filter("side is not null")
    return fits.log_step(s, ["account"], "side", "rate", "variance")


@query(None, ["STAT-5", "STAT-8"])
def headless_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quasi-Poisson factor of a share of the work on a day's count."""
    d = daily(spark, sf_dir).withColumns({"y": F.col("den") / 10.0, "share": (F.col("num") % 100) / 100.0})
    return fits.quasi_poisson(d, ["account"], "y", ["share"])


@query(None, ["STAT-43", "STAT-44"])
def family_rates_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative rates of each family's tokens in a percent of the meter."""
    from tidewater.plans.metering import closed_stretches

    design = family_design(spark, sf_dir).join(closed_stretches(spark, sf_dir).select("account", "ordinal", "delta_pct"), ["account", "ordinal"])
    return fits.nonnegative_rates(design, ["account"], "delta_pct", ["click", "error", "purchase"])


@query(None, [])
def median_rate_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the median rate over seeded resamples."""
    drawn = fits.replicates(stretch_rates_of(spark, sf_dir), ["account"], ["rate"], lambda f, rng: float(f["rate"].median()), 50, 3)
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return drawn.groupBy("account").agg(q[0].alias("lo"), q[1].alias("median"), q[2].alias("hi"), F.count("*").alias("draws"))


@query(None, ["BOOT-1", "AGG-18"])
def day_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.block_bootstrap(daily(spark, sf_dir), ["account"], "day", "num", "den", draws=200)


@query(None, ["STAT-56"])
def account_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_rates_of(spark, sf_dir).withColumn("era", (F.col("start_us") >= 1705276800000000).cast("int"))
    return fits.log_offsets(s, "account", "era", "rate", "delta_pct")


@query(None, ["STAT-1"])
def smoothed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.smoothed_changes(usd_per_pct_daily(spark, sf_dir), ["account"], "day", "usd_per_pct")


@query(None, ["STAT-2", "STAT-3", "STAT-4"])
def weighted_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.weighted_regimes(ordered.window_points(readings(spark, sf_dir), MAX_GAP), ["account"], "window_us")


@query(None, ["STAT-9", "STAT-11", "STAT-12", "STAT-13", "STAT-15", "STAT-16", "STAT-17"])
def permutation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared step at each instant of a grid, with a permutation p-value."""
    units = daily(spark, sf_dir).select("account", (F.col("day") * 24.0 + 12).alias("t"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    lo, hi = units.agg(F.min("t"), F.max("t")).first()
    taus = [lo + 48 + 24 * i for i in range(max(0, int((hi - lo - 96) / 24)))]
    return changes.scan(units, taus, permutations=500).drop("steps")


@query(None, ["SCAN-15", "TOP-3"])
def scan_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = permutation_scan(spark, sf_dir).filter("p < 0.2").select(F.lit("ratio").alias("line"), "tau", "p", "z", "step")
    return changes.episodes(hits, ["line"], "tau", 48.0, "p")


@query(None, ["STR-7", "STR-8", "STR-11", "FUZ-3"])
def hold_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's falls of the meter as finds, carried from day to day until a week in a row measures them."""
    r = ordered.reset_brackets(readings(spark, sf_dir))
    finds = r.select("account", F.lit("five_hour").alias("line"), F.lit(1).alias("sign"), F.floor(F.col("upper_us") / DAY).alias("day"), (F.col("upper_us") / HOUR % 24).alias("at"))
    return changes.held_states(finds, by=("account", "line", "sign"), match_hours=2.0, withdrawn=True)


CHECKS = VALUED + """, b AS (SELECT 'delta_at_least_threshold' AS name, account || ':' || ordinal AS row FROM stretch_values WHERE delta_pct < 10
UNION ALL SELECT 'ends_after_start', account || ':' || ordinal FROM stretch_values WHERE end_us <= start_us
UNION ALL SELECT 'value_is_positive', account || ':' || ordinal FROM stretch_values WHERE nano <= 0
UNION ALL SELECT 'one_piece', account || ':' || ordinal FROM stretch_values WHERE windows > 3)
SELECT name, count(*) AS failures, min(row) AS example FROM b GROUP BY name"""


@query(CHECKS, ["INV-1"])
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each named constraint."""
    s = stretch_values(spark, sf_dir)
    rules = {"delta_at_least_threshold": F.col("delta_pct") >= 10, "ends_after_start": F.col("end_us") > F.col("start_us"), "value_is_positive": F.col("nano") > 0, "one_piece": F.col("windows") <= 3}
    return checks.failures(s, rules, F.concat_ws(":", "account", "ordinal"))
