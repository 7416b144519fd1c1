"""Coupled shares, joint rates, searches for several changes, and fits with profiled levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.values import DAY
from tidewater.operators.cut import written
from tidewater.plans import figures
from tidewater.plans.base import PRICES, events, query
from tidewater.plans.metering import VALUED, closed_stretches
from tidewater.plans.relational import DAILY, daily, family_design
from tidewater.plans.reports import CUT_US
from tidewater.stats import changes, fits, robust, shares

POINTS = 161
FAMILIES = ["click", "error", "purchase"]

WORK = VALUED + f""", work AS (SELECT s.account, s.ordinal, s.end_us // 86400000000 AS day, s.end_us <= {CUT_US} AS early, s.delta_pct::DOUBLE AS pct,
 sum(CASE WHEN t.model IN ('click', 'error') THEN t.input ELSE 0 END)::DOUBLE AS own, sum(CASE WHEN t.model = 'purchase' THEN t.input ELSE 0 END)::DOUBLE AS extra FROM stretches s JOIN stretch_turns t USING (account, ordinal) WHERE s.end_us <= {CUT_US} OR s.start_us >= {CUT_US} GROUP BY ALL HAVING own + extra > 0)"""


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches on either side of an instant: the tokens of purchases as extra or new work, of clicks and errors as own."""
    s = closed_stretches(spark, sf_dir).select("account", "ordinal", "start_us", "end_us", F.col("delta_pct").alias("pct"))
    side = F.when(F.col("end_us") <= CUT_US, "before").when(F.col("start_us") >= CUT_US, "after")
    d = family_design(spark, sf_dir).join(s.withColumn("side", side).filter("side is not null"), ["account", "ordinal"])
    return d.select("account", "ordinal", F.floor(F.col("end_us") / DAY).alias("day"), "side", "pct", (F.col("click") + F.col("error")).cast("double").alias("own"), F.col("purchase").cast("double").alias("extra"), *FAMILIES)


def threes(scatter: DataFrame) -> DataFrame:
    """Three neighbouring accounts share one budget."""
    a = scatter.select("account", F.floor(F.col("account") / 3).alias("group")).distinct()
    return a.join(a.groupBy("group").agg(F.array(F.collect_list("account")).alias("caps")), "group")


@query(WORK + """, k AS (SELECT account FROM work WHERE own > 0 GROUP BY account HAVING sum(extra) > 0),
y AS (SELECT account, early, s, ln((own + s / 50.0::DOUBLE * extra) / pct) AS y FROM work JOIN k USING (account), range(51) g(s) WHERE own > 0 AND pct > 0),
p AS (SELECT account // 3 AS grp, account % 3 AS i, s, round(sum(ss) * 1e6)::BIGINT AS ss FROM (SELECT account, early, s, sum(y * y) - sum(y) * sum(y) / count(*) AS ss FROM y GROUP BY ALL) GROUP BY ALL),
q AS (SELECT * FROM p UNION ALL SELECT g.grp, i.i, 0, 0 FROM (SELECT DISTINCT grp FROM p) g, range(3) i(i) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.grp = g.grp AND p.i = i.i)),
t AS (SELECT a.grp, a.s AS s0, b.s AS s1, d.s AS s2, a.ss + b.ss + d.ss AS ss FROM q a JOIN q b USING (grp) JOIN q d USING (grp) WHERE a.i = 0 AND b.i = 1 AND d.i = 2 AND a.s + b.s + d.s <= 50),
w AS (SELECT grp, arg_min(struct_pack(s0, s1, s2), (ss, s0, s1, s2)) AS m FROM t GROUP BY grp)
SELECT p.grp * 3 + p.i AS account, p.s / 50.0::DOUBLE AS share, p.ss AS scatter FROM p JOIN w USING (grp) WHERE p.s = CASE p.i WHEN 0 THEN w.m.s0 WHEN 1 THEN w.m.s1 ELSE w.m.s2 END""", ["STAT-34", "STAT-35"])
def unclaimed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of extra work that makes each account's percent scatter least, three accounts to a budget."""
    s = shares.scatter_by_share(work(spark, sf_dir), "account", "side", "own", "extra", "pct")
    return shares.capped_shares(s, threes(s), "account")


@query(None, ["STAT-34"])
def unclaimed_share_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 95 % of each share over draws that weigh stretches by Poisson(1)."""
    drawn = work(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(40))))
    s = shares.scatter_by_share(drawn, "account", "side", "own", "extra", "pct", keys=["draw"], weight=fits.poisson_weight(9, "account", "ordinal", "draw"))
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    return shares.capped_shares(s, threes(s), "account", keys=["draw"]).groupBy("account").agg(q, F.count("*").alias("draws")).select("account", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "draws")


def joint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as the family that is new after the instant; before it, all work is known."""
    early = F.col("side") == "before"
    return work(spark, sf_dir).select("account", "day", "side", "pct", F.when(early, F.col("own") + F.col("extra")).otherwise(F.col("own")).alias("known"), F.when(early, 0.0).otherwise(F.col("extra")).alias("new"))


LO, STEP = math.log(shares.RATE_BOUNDS[0]), (math.log(shares.RATE_BOUNDS[1]) - math.log(shares.RATE_BOUNDS[0])) / (POINTS - 1)


@query(WORK + f""", b AS (SELECT account, avg(ln((own + extra) / pct)) AS level, count(*) AS n FROM work WHERE early AND own + extra > 0 AND pct > 0 GROUP BY account HAVING count(*) >= 5),
er AS (SELECT g, {LO!r}::DOUBLE + g * {STEP!r}::DOUBLE AS log_rate, ln((own + exp({LO!r}::DOUBLE + g * {STEP!r}::DOUBLE) * extra) / pct) - level AS e FROM work JOIN b USING (account), range({POINTS}) r(g) WHERE NOT early AND own + extra > 0 AND pct > 0),
f AS (SELECT g, log_rate, count(*) AS n, avg(e) AS m, sum(e * e) - sum(e) * sum(e) / count(*) AS ss FROM er GROUP BY ALL),
x AS (SELECT *, lag(ss) OVER o AS a, lead(ss) OVER o AS c, lag(m) OVER o AS ma, lead(m) OVER o AS mc FROM f WINDOW o AS (ORDER BY g)),
t AS (SELECT *, coalesce(CASE WHEN a - 2 * ss + c > 0 THEN (a - c) / (a - 2 * ss + c) / 2 END, 0) AS d FROM x ORDER BY ss, g LIMIT 1)
SELECT n, round(exp(log_rate + d * CASE WHEN c IS NULL THEN 0 ELSE {STEP!r}::DOUBLE END), 4) AS rate, round(m + d * coalesce((mc - ma) / 2, 0), 5) AS log_change, round(sqrt(greatest(ss, 0) / greatest(n - 1, 1)), 6) AS spread FROM t""", ["STAT-36"])
def joint_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new family's rate and the limit's change at its first use, by least squares over all accounts."""
    sums = shares.joint_by_account(shares.joint_sums(joint_rows(spark, sf_dir), "account", "day", POINTS), "account", "day")
    return shares.joint_best(sums, ["draw"]).select("n", F.round("rate", 4).alias("rate"), F.round("log_change", 5).alias("log_change"), F.round("spread", 6).alias("spread"))


@query(None, ["STAT-37"])
def joint_rate_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint fit with its interval over draws of days, and whether the rate is told apart from the change."""
    rows = written(joint_rows(spark, sf_dir), "joint")
    sums = shares.joint_by_account(shares.joint_sums(rows, "account", "day", POINTS), "account", "day", 40, 3)
    return shares.separable(shares.joint_interval(shares.joint_best(sums, ["draw"])), rows)


@query(None, ["STAT-36", "STAT-37"])
def joint_rate_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint fit by Huber's loss at the scatter that least squares leaves, with its interval over 200 draws of days."""
    variance = closed_stretches(spark, sf_dir).select("account", "ordinal", (F.col("windows") / (6 * F.col("delta_pct") * F.col("delta_pct"))).alias("variance"))
    early = F.col("side") == "before"
    own = F.col("own").alias("own")
    rows = work(spark, sf_dir).join(variance, ["account", "ordinal"]).withColumns({"known": F.when(early, F.col("own") + F.col("extra")).otherwise(own), "new": F.when(early, 0.0).otherwise(F.col("extra"))})
    rows = written(rows.select("account", "day", "side", "pct", "known", "new", "variance"), "stretches")
    plain = shares.joint_best(shares.joint_by_account(shares.joint_sums(rows, "account", "day", POINTS), "account", "day"), ["draw"]).first()
    schema = "n bigint, rate double, rate_lo double, rate_hi double, log_change double, change_lo double, change_hi double, spread double, pinned boolean, separable boolean, n_mixed bigint"
    if plain is None:
        return spark.createDataFrame([], schema)
    s2 = robust.scatter(rows, "account", plain["rate"], "variance")
    fit = robust.joint_fit(rows, "account", "day", "variance", (math.log(plain["rate"]), plain["log_change"]), s2, 200, 3)
    return shares.separable(shares.joint_interval(fit), rows)


@query(None, ["STAT-37", "STAT-40"])
def joint_rate_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint fit without each account in turn, and whether its change keeps the direction."""
    sums = shares.joint_by_account(shares.joint_sums(joint_rows(spark, sf_dir), "account", "day", 41), "account", "day", 20, 3)
    return shares.joint_without(sums, "account")


@query(None, ["STAT-38", "STAT-39"])
def absorbed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate table with two families' joint fits absorbed, oldest first: the later fit values its known work at the earlier one's rate."""
    list_price = {m: p for m, p, *_ in PRICES}
    rates = spark.createDataFrame([(f, 1.0, list_price[f] / list_price["click"], "given") for f in FAMILIES], "family string, rate double, list_ratio double, source string")
    # both fits and their checks read the rows
    w = written(work(spark, sf_dir), "work")
    for family in ("error", "purchase"):
        # One row a family.
        now = {r["family"]: r["rate"] for r in rates.collect()}
        valued = lambda names: sum((F.col(f) * now[f] for f in names), F.lit(0.0))  # noqa: B023, E731
        early = F.col("side") == "before"
        rows = w.select("account", "day", "side", "pct", F.when(early, valued(FAMILIES)).otherwise(valued([f for f in FAMILIES if f != family])).alias("known"), F.when(early, 0.0).otherwise(valued([family])).alias("new"))
        sums = shares.joint_by_account(shares.joint_sums(rows, "account", "day", 81), "account", "day", 20, 3)
        rates = shares.adopted(rates, shares.separable(shares.joint_interval(shares.joint_best(sums, ["draw"])), rows), family, now[family])
    return rates


@query(""", g AS (SELECT i, j, 0.2 * exp(ln(15) / 20 * i) AS w1, 0.2 * exp(ln(15) / 20 * j) AS w2 FROM range(21) a(i), range(21) b(j)),
r AS (SELECT day % 2 AS era, y, n::DOUBLE AS base, c AS f, p AS s FROM (SELECT account, ts_us // 86400000000 AS day, sum(cents) / 100.0::DOUBLE AS y, count(*) AS n, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS c, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS p FROM e GROUP BY ALL)),
s AS (SELECT i, j, era, count(*) AS n, sum(y) AS w, sum(y * ln((base + w1 * f + w2 * s) / y)) AS s, sum(y * pow(ln((base + w1 * f + w2 * s) / y), 2)) AS q FROM r, g WHERE y > 0 GROUP BY ALL),
c AS (SELECT i, j, sum(n)::BIGINT AS n, round(sum(q - s * s / w), 6) AS ss FROM s GROUP BY ALL), b AS (SELECT * FROM c ORDER BY ss, i, j LIMIT 1),
x AS (SELECT b.i AS bi, b.j AS bj, b.n, b.ss, min(c.i) AS i0, max(c.i) AS i1, min(c.j) AS j0, max(c.j) AS j1 FROM c, b WHERE c.ss <= b.ss + 3.84::DOUBLE * b.ss / greatest(b.n - 4, 1) GROUP BY ALL)
SELECT n, ss, round(0.2 * exp(ln(15) / 20 * bi), 9) AS first_weight, round(0.2 * exp(ln(15) / 20 * i0), 9) AS first_lo, round(0.2 * exp(ln(15) / 20 * i1), 9) AS first_hi,
 round(0.2 * exp(ln(15) / 20 * bj), 9) AS second_weight, round(0.2 * exp(ln(15) / 20 * j0), 9) AS second_lo, round(0.2 * exp(ln(15) / 20 * j1), 9) AS second_hi FROM x""", ["STAT-57"])
def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of clicks and purchases beside all events, one scale on even days and one on odd ones."""
    of = lambda kind: F.count_if(F.col("event_type") == kind).cast("double")
    d = events(spark, sf_dir).groupBy("account", F.floor(F.col("ts_us") / DAY).alias("day")).agg((F.sum("cents") / F.lit(100.0)).alias("y"), F.count("*").cast("double").alias("base"), of("click").alias("c"), of("purchase").alias("p"))
    out = fits.source_weights(d.withColumn("era", F.col("day") % 2), "era", "y", "base", "c", "p", "y", 21)
    return out.select("n", "ss", *(F.round(c, 9).alias(c) for c in out.columns if c not in ("n", "ss")))


@query(None, ["STAT-7"])
def headless_within_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor of a share of the work on a day's count, with a level for each account and week."""
    d = daily(spark, sf_dir).select("account", F.floor((F.col("day") + 3) / 7).alias("week"), (F.col("den") / 10.0).alias("y"), ((F.col("num") % 100) / 100.0).alias("share"))
    return shares.factor_within(d, ["account", "week"], "y", "share")


@query(None, ["STAT-6"])
def headless_with_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor of a share of the work on a day's count, with a level for each account and one for what follows an instant."""
    d = daily(spark, sf_dir).select("account", (F.col("day") >= CUT_US // DAY).cast("int").alias("late"), (F.col("den") / 10.0).alias("y"), ((F.col("num") % 100) / 100.0).alias("share"))
    return shares.factor_within(d, ["account"], "y", "share", ["late"], least_rows=50)


@query(None, ["STAT-51"])
def pooled_rate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families' rates that all accounts share, with the middle 95 % of draws inside each account and the span over fits without one account."""
    d = figures.design(spark, sf_dir).select("account", "ordinal", "delta_pct", *FAMILIES).persist()
    try:
        whole = fits.pooled_log_rates(d, "account", "delta_pct", FAMILIES)
        drawn = fits.pooled_rate_draws(d, "account", "delta_pct", FAMILIES, ["account", "ordinal"], 40, whole=whole)
        left = fits.pooled_rates_without(d, "account", "delta_pct", FAMILIES, whole)
    finally:
        d.unpersist()
    q = F.percentile(F.when(F.col("draw") > 0, F.col("rate")), F.array(F.lit(0.025), F.lit(0.975)))
    rates = drawn.groupBy("name").agg(F.max(F.when(F.col("draw") == 0, F.col("rate"))).alias("rate"), q.alias("q"))
    without = left.groupBy("name").agg(F.min("rate").alias("least_without"), F.max("rate").alias("most_without"))
    return rates.join(without, "name").select(F.col("name").alias("family"), "rate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "least_without", "most_without")


# --- several changes ---------------------------------------------------------------------------------


def units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    """Each account's day, stored since a search reads it every round, and the instants to search."""
    u = daily(spark, sf_dir).select("account", (F.col("day") * 24.0 + 12).alias("t"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    u = written(u, "units")
    lo, hi = u.agg(F.min("t"), F.max("t")).first()
    return u, [] if lo is None else [lo + 48 + 24 * i for i in range(max(0, int((hi - lo - 96) / 24)))]


@query(None, ["STAT-14", "STAT-18"])
def change_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that all accounts share, one after the other, with as many shuffles as each instant needs."""
    u, grid = units(spark, sf_dir)
    found = changes.search(u, grid, 2000)
    return spark.createDataFrame([(i, r["tau"], r["step"], r["z"], r["p"], r["permutations"]) for i, r in enumerate(found)], "ordinal int, tau double, step double, z double, p double, permutations int")


@query(None, ["STAT-14", "STAT-18"])
def planted_change_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search where every account's events cost twice as much from an instant on, and three fifths more from a later one."""
    u, grid = units(spark, sf_dir)
    if not grid:
        return change_search(spark, sf_dir)
    first, second = grid[len(grid) // 3], grid[2 * len(grid) // 3]
    u = u.withColumn("num", F.col("num") * F.when(F.col("t") >= second, 3.2).when(F.col("t") >= first, 2.0).otherwise(1.0))
    found = changes.search(u, grid, 2000)
    return spark.createDataFrame([(i, r["tau"], r["tau"] - first, r["tau"] - second, r["step"], r["z"], r["p"], r["permutations"]) for i, r in enumerate(found)], "ordinal int, tau double, after_first double, after_second double, step double, z double, p double, permutations int")


@query(DAILY + """, ends AS (SELECT min(day) AS lo, max(day) AS hi FROM d), g AS (SELECT unnest(range(lo + 2, hi - 2)) AS cut FROM ends),
x AS (SELECT cut, account, day >= cut AS after, num::DOUBLE AS num, den::DOUBLE AS den FROM g JOIN d ON day >= cut - 14 AND day < cut + 14 WHERE den > 0),
a AS (SELECT cut, account, sum(num) / sum(den) AS level FROM x GROUP BY ALL HAVING count_if(after) >= 2 AND count_if(NOT after) >= 2 AND sum(num) > 0),
p AS (SELECT cut, account, level, avg(pow(num - level * den, 2) / den) AS prior FROM x JOIN a USING (cut, account) GROUP BY ALL),
s AS (SELECT cut, account, after, sum(num) / sum(den) AS ratio, sum(den) AS total, count(*) AS k FROM x GROUP BY ALL),
q AS (SELECT cut, account, after, ratio, total, k, sum(pow(num - ratio * den, 2) / den) AS squares FROM x JOIN s USING (cut, account, after) GROUP BY ALL),
v AS (SELECT cut, account, CASE WHEN after THEN 1 ELSE -1 END * ln(greatest(ratio, 1e-12) / level) AS part, (squares + 4 * prior) / (k + 3) / total / pow(greatest(ratio, 1e-12), 2) AS variance FROM q JOIN p USING (cut, account)),
u AS (SELECT cut, account, sum(part) AS step, sum(variance) AS variance FROM v GROUP BY ALL)
SELECT cut * 24.0::DOUBLE + 12 AS tau, round(sum(step / variance) / sum(1 / variance), 6) AS step, round(sum(step / variance) / sqrt(sum(1 / variance)), 6) AS z, round(1 / sqrt(sum(1 / variance)), 6) AS se, count(*) AS voting FROM u GROUP BY cut""", ["STAT-11", "STAT-12"])
def shared_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that all accounts share at each day, and its z, before any shuffle."""
    u, grid = units(spark, sf_dir)
    v = changes.votes(u, grid, permutations=0).filter("account is not null")
    w, wx = F.sum(1 / F.col("variance")), F.sum(F.col("step") / F.col("variance"))
    return v.groupBy("tau").agg(F.round(wx / w, 6).alias("step"), F.round(wx / F.sqrt(w), 6).alias("z"), F.round(1 / F.sqrt(w), 6).alias("se"), F.count("*").alias("voting"))


@query(None, ["STAT-22"])
def change_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a change at two instants, by account and without each."""
    u, grid = units(spark, sf_dir)
    return changes.sizes(u, grid[len(grid) // 3 :: max(1, len(grid) // 3)][:2], 1.2)


@query(None, ["STAT-25"])
def change_retest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Would the search find a change carried from the middle of the record again."""
    u, grid = units(spark, sf_dir)
    at = grid[len(grid) // 2]
    r = changes.found_again(u, grid, at, 1, (at - 24, at + 24), [at], permutations=1000, most=4000)
    return spark.createDataFrame([(r["at"], r["found_today"], r["p"], r["z"])], "at double, found_today boolean, p double, z double")
