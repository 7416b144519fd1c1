"""Published figures: rules over the engine's own output, updates by method, and fits of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import checks
from tidewater.functions.values import DAY, HOUR
from tidewater.operators import asof, dedupe
from tidewater.operators.cut import written
from tidewater.plans.base import events, query, readings
from tidewater.plans.metering import VALUED, closed_stretches, pair_rows, stretch_values
from tidewater.plans.relational import DAILY, daily, family_design
from tidewater.plans.reports import CUT_US
from tidewater.stats import fits

FAMILIES = ["click", "error", "purchase"]

RULES = VALUED + """, v AS (SELECT account, end_us // 86400000000 AS day, nano, delta_pct FROM stretch_values WHERE nano > 0),
du AS (SELECT account, day, sum(nano)::DOUBLE / sum(delta_pct) AS v FROM v GROUP BY ALL), dh AS (SELECT day + 1 AS day, sum(nano)::DOUBLE / sum(delta_pct) AS v FROM v GROUP BY day),
au AS (SELECT account, sum(nano)::DOUBLE / sum(delta_pct) AS v, median(nano / delta_pct) AS m, sum(nano)::DOUBLE AS n FROM v GROUP BY account),
ad AS (SELECT account, sum(n)::DOUBLE AS n FROM (SELECT account, day, sum(nano) AS n FROM v GROUP BY ALL) GROUP BY account),
nw AS (SELECT account, max(ts_us) AS newest FROM readings GROUP BY account)
SELECT 'headline_inside_accounts' AS rule, day::VARCHAR AS row FROM dh JOIN (SELECT day, min(v) AS lo, max(v) AS hi FROM du GROUP BY day HAVING count(*) >= 2) USING (day) WHERE NOT v BETWEEN lo * 0.98::DOUBLE AND hi * 1.02::DOUBLE
UNION ALL SELECT 'direct_means_direct', account::VARCHAR FROM au JOIN ad USING (account) WHERE abs(au.n - ad.n) > 1e-9 * abs(ad.n)
UNION ALL SELECT 'account_units', account::VARCHAR FROM au WHERE abs(v - m) > 0.1 * abs(m)
UNION ALL SELECT 'measured_changes_still_found', account || ':' || seq FROM pairs WHERE delta <= -50 AND abs(resets_us - prev_resets_us) <= 60000000
UNION ALL SELECT 'detector_ran', account::VARCHAR FROM nw WHERE (SELECT max(newest) FROM nw) - newest > 86400000000"""


@query(RULES, ["INV-2", "INV-4", "INV-11"])
def figure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the rules between figures: yesterday's headline inside the accounts of a day, equal sums, a unit near the direct reading, large falls that a reset explains, and a meter read within a day."""
    v = stretch_values(spark, sf_dir).filter("nano > 0").select("account", F.floor(F.col("end_us") / DAY).alias("day"), "nano", "delta_pct")
    rate = (F.sum("nano").cast("double") / F.sum("delta_pct")).alias("v")
    headline = v.groupBy((F.col("day") + 1).alias("day")).agg(rate)
    direct = v.groupBy("account").agg(F.sum("nano").cast("double").alias("v"))
    by_day = v.groupBy("account", "day").agg(F.sum("nano").alias("n")).groupBy("account").agg(F.sum("n").cast("double").alias("v"))
    medians = v.groupBy("account").agg(F.median(F.col("nano") / F.col("delta_pct")).alias("v"))
    pairs = pair_rows(spark, sf_dir)
    found = pairs.filter(F.abs(F.col("resets_us") - F.col("prev_resets_us")) > 60_000_000).select("account", "seq")
    newest = readings(spark, sf_dir).groupBy("account").agg(F.max("ts_us").alias("newest"))
    late = newest.crossJoin(F.broadcast(newest.agg(F.max("newest").alias("_now")))).filter(F.col("_now") - F.col("newest") > DAY)
    told = lambda rule, df, row: df.select(F.lit(rule).alias("rule"), row.cast("string").alias("row"))
    return dedupe.union_all(
        told("headline_inside_accounts", checks.inside(headline, v.groupBy("account", "day").agg(rate), ["day"], "v", 0.02), F.col("day")),
        told("direct_means_direct", checks.agreeing(direct, by_day, ["account"], "v", 1e-9), F.col("account")),
        told("account_units", checks.agreeing(v.groupBy("account").agg(rate), medians, ["account"], "v", 0.1), F.col("account")),
        told("measured_changes_still_found", pairs.filter("delta <= -50").join(found, ["account", "seq"], "left_anti"), F.concat_ws(":", "account", "seq")),
        told("detector_ran", late, F.col("account")),
    )


@query(""", r AS (SELECT event_id, user_id, ts_us, lpad(event_id::VARCHAR, 8, '0') AS p FROM e WHERE event_type = 'click'),
l AS (SELECT user_id, ts_us AS at, max(event_id) AS launch FROM e WHERE event_type = 'purchase' GROUP BY ALL),
i AS (SELECT lpad((event_id + 1)::VARCHAR, 8, '0') AS p, event_id AS launch FROM e WHERE event_type = 'purchase' AND event_id % 3 = 0)
SELECT r.event_id, coalesce(i.launch, CASE WHEN r.ts_us - l.at <= 172800000000 THEN l.launch END) AS launch, CASE WHEN i.launch IS NOT NULL THEN 'id' WHEN r.ts_us - l.at <= 172800000000 THEN 'name' END AS matched
FROM r ASOF LEFT JOIN l ON l.user_id = r.user_id AND r.ts_us >= l.at LEFT JOIN i USING (p)""", ["FUZ-2"])
def launch_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as runs and purchases as launches, some of which name the run they start."""
    e = events(spark, sf_dir)
    padded = lambda c: F.lpad(c.cast("string"), 8, "0")
    runs = e.filter("event_type = 'click'").select("event_id", "user_id", "ts_us", F.concat(padded(F.col("event_id")), F.lit("-run")).alias("run_id"))
    launches = e.filter("event_type = 'purchase'").select("user_id", F.col("ts_us").alias("at"), F.col("event_id").alias("launch"), F.when(F.col("event_id") % 3 == 0, padded(F.col("event_id") + 1)).alias("names"))
    return asof.matched_launch(runs, launches, ["user_id"], "ts_us", "at", "run_id", "names", "launch", 48 * HOUR).select("event_id", "launch", "matched")


@query(DAILY + """, s AS (SELECT account, sum(den::DOUBLE / 1000) AS w, sum(den::DOUBLE / 1000 * round(ln(num::DOUBLE / den), 6)) AS wx FROM d GROUP BY account),
t AS (SELECT *, sum(w) OVER () - w AS w_, sum(wx) OVER () - wx AS wx_, sum(wx) OVER () / sum(w) OVER () AS mean FROM s)
SELECT account, round(wx_ / w_, 9) AS without, round(1 / sqrt(w_), 9) AS se, abs(wx_ / w_ - mean) <= 1.96::DOUBLE / sqrt(w_) AS holds FROM t WHERE w_ > 0""", ["STAT-40"])
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled level without each account, and whether the pooled one lies inside its interval."""
    w = F.col("den") / 1000.0
    s = daily(spark, sf_dir).groupBy("account").agg(F.sum(w).alias("w"), F.sum(w * F.round(F.log(F.col("num") / F.col("den")), 6)).alias("wx"))
    t = s.crossJoin(F.broadcast(s.agg(F.sum("w").alias("all_w"), F.sum("wx").alias("all_wx")))).withColumns({"rest": F.col("all_w") - F.col("w"), "x": F.try_divide(F.col("all_wx") - F.col("wx"), F.col("all_w") - F.col("w"))})
    return t.filter("rest > 0").select("account", F.round("x", 9).alias("without"), F.round(1 / F.sqrt("rest"), 9).alias("se"), (F.abs(F.col("x") - F.col("all_wx") / F.col("all_w")) <= F.lit(1.96) / F.sqrt("rest")).alias("holds"))


@query(VALUED + """, r AS (SELECT account, a.anchor, nano / 1e11 / delta_pct * a.anchor AS rate FROM stretch_values, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) a(anchor) WHERE nano > 0)
SELECT account, anchor, quantile_cont(rate, 0.1) AS lo, quantile_cont(rate, 0.5) AS middle, quantile_cont(rate, 0.9) AS hi, count(*) AS n FROM r GROUP BY ALL""", ["STAT-60"])
def rate_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 80 % of an account's rates at each anchor."""
    s = stretch_values(spark, sf_dir).filter("nano > 0").select("account", (F.col("nano") / F.lit(1e11) / F.col("delta_pct")).alias("base"), F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("anchor"))
    q = F.percentile(F.col("base") * F.col("anchor"), F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    return s.groupBy("account", "anchor").agg(q.alias("q"), F.count("*").alias("n")).select("account", "anchor", F.col("q")[0].alias("lo"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("hi"), "n")


@query(VALUED + f""", r AS (SELECT account, end_us < {CUT_US} AS early, nano / 1e11 / delta_pct AS rate FROM stretch_values WHERE nano > 0),
o AS (SELECT account, quantile_cont(rate, 0.1) AS lo, median(rate) AS old, quantile_cont(rate, 0.9) AS hi FROM r WHERE early GROUP BY account), n AS (SELECT account, median(rate) AS new FROM r WHERE NOT early GROUP BY account)
SELECT account, old, new, CASE WHEN new < lo THEN 'fell' WHEN new > hi THEN 'rose' ELSE 'inside' END AS move FROM o JOIN n USING (account)""", ["STAT-52"])
def rate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accounts' refitted rates left the interval of the earlier fit."""
    s = stretch_values(spark, sf_dir).filter("nano > 0").select("account", (F.col("end_us") < CUT_US).alias("early"), (F.col("nano") / F.lit(1e11) / F.col("delta_pct")).alias("rate"))
    q = F.percentile("rate", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q")
    old, new = s.filter("early").groupBy("account").agg(q), s.filter("not early").groupBy("account").agg(F.median("rate").alias("new"))
    move = F.when(F.col("new") < F.col("q")[0], "fell").when(F.col("new") > F.col("q")[2], "rose").otherwise("inside")
    return old.join(new, "account").select("account", F.col("q")[1].alias("old"), "new", move.alias("move"))


@query(DAILY + """, stored AS (SELECT account, day, num AS n, CASE WHEN account % 2 = 0 THEN 'a' ELSE 'b' END AS method FROM d WHERE day < (SELECT max(day) FROM d)), fresh AS (SELECT account, day, den AS n, 'b' AS method FROM d),
h AS (SELECT account, CASE WHEN bool_and(method = 'b') THEN max(day) - 1 END AS since FROM stored GROUP BY account)
SELECT s.account, s.day, s.n, s.method FROM stored s JOIN h USING (account) WHERE s.day < since UNION ALL SELECT f.account, f.day, f.n, f.method FROM fresh f LEFT JOIN h USING (account) WHERE since IS NULL OR f.day >= since""", ["SNK-6", "STR-4"])
def update_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days anew where the stored method is today's, everything anew where it is not."""
    d = daily(spark, sf_dir)
    newest = d.agg(F.max("day").alias("_newest"))
    stored = d.crossJoin(F.broadcast(newest)).filter("day < _newest").select("account", "day", F.col("num").alias("n"), F.when(F.col("account") % 2 == 0, "a").otherwise("b").alias("method"))
    fresh = d.select("account", "day", F.col("den").alias("n"), F.lit("b").alias("method"))
    return dedupe.update_by_method(stored, fresh, ["account"], "day", "method", "b")


# --- fits: drawn or iterated, tested against planted rates --------------------------------------------


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_design(spark, sf_dir).join(closed_stretches(spark, sf_dir).select("account", "ordinal", "delta_pct"), ["account", "ordinal"])


@query(None, ["STAT-45"])
def family_rates_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 80 % of each family's rate over refits to resampled stretches."""
    drawn = fits.fit_draws(design(spark, sf_dir), ["account"], "delta_pct", FAMILIES, ["account", "ordinal"], 60, 5)
    q = F.percentile("rate", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q")
    return drawn.groupBy("account", "name").agg(q, F.count("*").alias("draws")).select("account", F.col("name").alias("family"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("hi"), "draws")


@query(None, ["STAT-46"])
def median_ratio_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median rate after an instant over the one before, with the middle 80 % of resamples."""
    s = stretch_values(spark, sf_dir).filter("nano > 0").select("account", (F.col("nano") / F.lit(1e11) / F.col("delta_pct")).alias("rate"), (F.col("end_us") < CUT_US).cast("double").alias("early"))
    ratio = lambda f, rng: float(f.loc[f["early"] == 0, "rate"].median() / f.loc[f["early"] == 1, "rate"].median())
    drawn = fits.replicates(s, ["account"], ["rate", "early"], ratio, 60, 7).filter(~F.isnan("value"))
    q = F.percentile("value", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q")
    return drawn.groupBy("account").agg(q, F.count("*").alias("draws")).select("account", F.col("q")[0].alias("lo"), F.col("q")[1].alias("ratio"), F.col("q")[2].alias("hi"), "draws")


@query(None, ["STAT-55"])
def held_out_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of every other stretch predict the rest."""
    return fits.held_out(design(spark, sf_dir).withColumn("test", F.col("ordinal") % 2 == 1), ["account"], "delta_pct", FAMILIES, "test", 60)


@query(None, ["STAT-53"])
def best_long_answer_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per account, the weight of purchases beside clicks that makes the tokens of a percent scatter least."""
    import numpy as np

    def kernel(f):  # type: ignore[no-untyped-def]
        f = f[f["click"] + f["purchase"] > 0].sort_values(["delta_pct", "click", "purchase"])
        a, b, y = (f[c].to_numpy(float) for c in ("click", "purchase", "delta_pct"))
        return {"weight": fits.best_on_grid(lambda w: float(np.var(np.log((a + np.exp(w) * b + 1) / y))), -3, 3) if len(f) > 2 else None, "n": float(len(f))}

    return fits.grouped(design(spark, sf_dir), ["account"], ["click", "purchase", "delta_pct"], kernel, "weight double, n double")


@query(None, ["STAT-50"])
def pooled_family_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families' rates that all accounts share, clicks being 1."""
    # every round of the fit reads the rows
    rows = written(design(spark, sf_dir).select("account", "delta_pct", *FAMILIES), "design")
    found = fits.pooled_log_rates(rows, "account", "delta_pct", FAMILIES)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "family string, rate double")
