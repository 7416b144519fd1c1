"""Daily runs with state, alerts, regimes told by clusters, and what rounding explains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater import checks
from tidewater.functions import values as V
from tidewater.functions.values import DAY, HOUR
from tidewater.operators import documents, sets
from tidewater.operators.cut import written
from tidewater.plans.base import events, query, turns
from tidewater.plans.metering import VALUED, closed_stretches, stored_stretches, stretch_values
from tidewater.plans.relational import family_design
from tidewater.stats import daily, feasible, regimes
from tidewater.streaming import alerts

FAMILIES = ["click", "error", "purchase"]
#: A plan of the test tables: four accounts. Their noise is larger and their record shorter than the method's, so the search is looser.
LOOSE = daily.Rules(alpha=0.05, permutations=500, most=2000, screen=1.5, hold_days=2)


def plan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's day on two lines: cents a count of views, and of all events."""
    e = events(spark, sf_dir)
    d = e.groupBy("account", F.floor(F.col("ts_us") / DAY).alias("day")).agg(F.sum("cents").cast("double").alias("num"), F.count_if(F.col("event_type") == "view").cast("double").alias("views"), F.count("*").cast("double").alias("all"))
    lines = F.explode(F.create_map(F.lit("views"), F.col("views"), F.lit("all"), F.col("all"))).alias("line", "den")
    return d.select(F.floor(F.col("account") / 4).cast("string").alias("plan"), F.col("account").cast("string").alias("account"), (F.col("day") * 24.0 + 12).alias("t"), "num", lines)


@query(None, ["STR-6", "STR-9", "STR-10", "STR-7", "STR-8", "STR-11", "FUZ-3", "STAT-18", "STAT-19", "STAT-20", "STAT-22", "STAT-25"])
def daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's run of each plan: what it held, measured, carried and withdrew, each from the run before."""
    return daily.replay(plan_units(spark, sf_dir), LOOSE).drop("finds")


@query(None, ["STR-13"])
def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each account's hours as runs: one fails without a purchase or with more errors than clicks, and a kind of event that is missing is a failing check."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    h = events(spark, sf_dir).groupBy("account", F.floor(F.col("ts_us") / HOUR).alias("hour")).agg(of("click").alias("c"), of("error").alias("e"), of("purchase").alias("p"), of("view").alias("v"))
    missing = F.array_compact(F.array(*[F.when(F.col(c) == 0, f"meters/{name}") for c, name in (("c", "click"), ("v", "view"))], F.when(F.col("e") >= 8, "page/age")))
    reports = h.select(F.col("account").cast("string").alias("key"), F.timestamp_micros((F.col("hour") + 1) * HOUR).alias("at"), ((F.col("p") == 0) | (F.col("e") > F.col("c"))).alias("failed"), (F.col("e") > 3 * F.col("c") + 3).alias("by_hand"), missing.alias("kinds"))
    until = reports.agg(F.max(F.unix_micros("at"))).first()[0]
    return alerts.alert_log(reports, alerts.Rules(threshold=3, stale_us=3 * HOUR, immediate=frozenset({"meters/view"})), until)


READINGS = VALUED + """, f AS (SELECT s.account, s.ordinal, coalesce(sum(t.input) FILTER (WHERE t.model = 'click'), 0) AS click, coalesce(sum(t.input) FILTER (WHERE t.model = 'error'), 0) AS error, coalesce(sum(t.input) FILTER (WHERE t.model = 'purchase'), 0) AS purchase FROM stretches s JOIN stretch_turns t USING (account, ordinal) GROUP BY ALL HAVING sum(t.input) > 0),
r AS (SELECT account, start_us AS start, CASE WHEN click >= error AND click >= purchase THEN 'click' WHEN error >= purchase THEN 'error' ELSE 'purchase' END AS family, nano / 1e11 / delta_pct AS value FROM stretch_values JOIN f USING (account, ordinal) WHERE nano > 0),
reading AS (SELECT *, value * CASE family WHEN 'click' THEN 1 WHEN 'error' THEN 1.25 ELSE 0.8 END::DOUBLE AS anchor_value FROM r),
day_rate AS (SELECT account, start_us // 86400000000 AS day, sum(nano) / 1e11 / sum(delta_pct) AS rate FROM stretch_values WHERE nano > 0 GROUP BY ALL),
change AS (SELECT account, cut, ratio, ratio * 0.9::DOUBLE AS lo, ratio * 1.1::DOUBLE AS hi, abs(ln(ratio)) >= 0.2 AS scaled FROM (SELECT account, day * 86400000000 AS cut, rate / lag(rate) OVER (PARTITION BY account ORDER BY day) AS ratio FROM day_rate) WHERE ratio IS NOT NULL)"""


def readings_and_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stretches as readings in their largest family's units, and each day's step of an account's rate as a change; both read the stored stretches."""
    s = stored_stretches(spark, sf_dir, FAMILIES).filter("nano > 0")
    top = F.when((F.col("click") >= F.col("error")) & (F.col("click") >= F.col("purchase")), "click").when(F.col("error") >= F.col("purchase"), "error").otherwise("purchase")
    value = F.col("nano") / F.lit(1e11) / F.col("delta_pct")
    factor = F.when(F.col("family") == "click", 1.0).when(F.col("family") == "error", 1.25).otherwise(0.8)
    used = s.filter(" + ".join(FAMILIES) + " > 0").withColumn("family", top)
    r = used.select("account", F.col("start_us").alias("start"), "family", value.alias("value"), (value * factor).alias("anchor_value"))
    d = s.groupBy("account", F.floor(F.col("start_us") / DAY).alias("day")).agg((F.sum("nano") / F.lit(1e11) / F.sum("delta_pct")).alias("rate"))
    ratio = F.col("rate") / F.lag("rate").over(W.partitionBy("account").orderBy("day"))
    c = d.withColumn("ratio", ratio).filter("ratio is not null")
    return r, c.select("account", (F.col("day") * DAY).cast("bigint").alias("at"), "ratio", (F.col("ratio") * 0.9).alias("lo"), (F.col("ratio") * 1.1).alias("hi"), (F.abs(F.log("ratio")) >= 0.2).alias("scaled"))


FIGURES = ["value", "lo", "hi", "measured_value", "measured_lo", "measured_hi", "bridge_rate"]


@query(READINGS + """,
reg AS (SELECT account, cut, ratio, lo, hi, scaled, row_number() OVER (PARTITION BY account ORDER BY cut) AS k FROM change UNION ALL SELECT DISTINCT account, NULL, NULL, NULL, NULL, true, 0 FROM change),
reg2 AS (SELECT *, lead(cut) OVER (PARTITION BY account ORDER BY k) AS until, sum((scaled AND k > 0)::INT) OVER (PARTITION BY account ORDER BY k) AS run FROM reg),
inside AS (SELECT g.account, g.k, g.run, r.family, r.value, r.anchor_value FROM reg2 g JOIN reading r ON r.account = g.account AND (g.cut IS NULL OR r.start >= g.cut) AND (g.until IS NULL OR r.start < g.until)),
own AS (SELECT account, k, family, count(*) AS n, median(value) AS m, min(value) AS mlo, max(value) AS mhi, median(anchor_value) AS a, min(anchor_value) AS alo, max(anchor_value) AS ahi FROM inside GROUP BY account, k, family QUALIFY row_number() OVER (PARTITION BY account, k ORDER BY count(*) DESC, family) = 1),
bulk AS (SELECT account, run, family, count(*) AS n, median(value) AS m, min(value) AS mlo, max(value) AS mhi, median(anchor_value) AS a, min(anchor_value) AS alo, max(anchor_value) AS ahi FROM inside GROUP BY account, run, family QUALIFY row_number() OVER (PARTITION BY account, run ORDER BY count(*) DESC, family) = 1),
span AS (SELECT account, run, min(k) AS first_k, arg_min(coalesce(cut, -1), k) AS run_at FROM reg2 GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT g.*, b.account IS NOT NULL AS in_run, s.first_k, nullif(s.run_at, -1) AS run_from, coalesce(b.family, o.family) AS family, coalesce(b.n, o.n, 0) AS n, coalesce(b.m, o.m) AS m, coalesce(b.mlo, o.mlo) AS mlo, coalesce(b.mhi, o.mhi) AS mhi, coalesce(b.a, o.a) AS a, coalesce(b.alo, o.alo) AS alo, coalesce(b.ahi, o.ahi) AS ahi
  FROM reg2 g LEFT JOIN span s ON s.account = g.account AND s.run = g.run LEFT JOIN bulk b ON b.account = s.account AND b.run = s.run AND b.n >= 5 LEFT JOIN own o ON o.account = g.account AND o.k = g.k),
w AS (
  SELECT account, k, cut, until, in_run, run_from, family AS regime_family, n AS n_regime_family, in_run OR n > 0 AS seen, CASE WHEN in_run THEN 'run_cluster' WHEN n > 0 THEN 'cluster' ELSE 'carried' END AS source,
    a AS value, alo AS lo, ahi AS hi, family AS measured_family, m AS measured_value, mlo AS measured_lo, mhi AS measured_hi, NULL::DOUBLE AS bridge_rate FROM x WHERE k = 0
  UNION ALL
  SELECT x.account, x.k, x.cut, x.until, x.in_run, CASE WHEN x.in_run THEN x.run_from END, x.family, x.n, w.seen OR x.in_run OR x.n > 0,
    CASE WHEN x.in_run THEN 'run_cluster' WHEN x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN 'cluster' WHEN x.scaled THEN 'scaled' ELSE 'carried' END,
    CASE WHEN x.in_run AND x.k > x.first_k THEN w.value WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN CASE WHEN w.seen AND x.scaled AND x.family <> 'click' THEN w.value * x.ratio ELSE x.a END WHEN x.scaled THEN w.value * x.ratio ELSE w.value END,
    CASE WHEN x.in_run AND x.k > x.first_k THEN w.lo WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN CASE WHEN w.seen AND x.scaled AND x.family <> 'click' THEN x.mlo * w.value * x.ratio / x.m ELSE x.alo END WHEN x.scaled THEN w.lo * x.lo ELSE w.lo END,
    CASE WHEN x.in_run AND x.k > x.first_k THEN w.hi WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN CASE WHEN w.seen AND x.scaled AND x.family <> 'click' THEN x.mhi * w.value * x.ratio / x.m ELSE x.ahi END WHEN x.scaled THEN w.hi * x.hi ELSE w.hi END,
    CASE WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN x.family ELSE w.measured_family END,
    CASE WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN x.m WHEN x.scaled THEN w.measured_value * x.ratio ELSE w.measured_value END,
    CASE WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN x.mlo WHEN x.scaled THEN w.measured_lo * x.lo ELSE w.measured_lo END,
    CASE WHEN x.in_run OR x.n >= 5 OR (NOT w.seen AND x.n > 0) THEN x.mhi WHEN x.scaled THEN w.measured_hi * x.hi ELSE w.measured_hi END,
    CASE WHEN NOT (x.in_run AND x.k > x.first_k) AND (x.in_run OR x.n >= 5) AND w.seen AND x.scaled AND x.family <> 'click' THEN w.value * x.ratio / x.m END
  FROM w JOIN x ON x.account = w.account AND x.k = w.k + 1)
SELECT account, k::INT AS regime, cut AS from_us, until, source, round(value, 9) AS value, round(lo, 9) AS lo, round(hi, 9) AS hi, measured_family, round(measured_value, 9) AS measured_value, round(measured_lo, 9) AS measured_lo, round(measured_hi, 9) AS measured_hi, regime_family, n_regime_family, CASE WHEN in_run THEN run_from END AS run_from, round(bridge_rate, 9) AS bridge_rate FROM w""", ["STAT-61"])
def window_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's regimes between its daily changes, told by clusters of runs or carried."""
    r, c = readings_and_changes(spark, sf_dir)
    out = regimes.cluster_regimes(c, r, ["account"], "click")
    return out.withColumns({c: F.round(c, 9) for c in FIGURES})


@query(None, ["STAT-54"])
def rounding_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least slack beyond whole percents with which constant rates of three families explain each account's stretches."""
    s = closed_stretches(spark, sf_dir).select("account", "ordinal", "delta_pct", "windows")
    d = family_design(spark, sf_dir).join(s, ["account", "ordinal"])
    out = feasible.rounding_slack(d, ["account"], "delta_pct", "windows", FAMILIES)
    return out.withColumn("extra", F.round("extra", 7))


@query(None, ["INV-3", "INV-5", "INV-6", "INV-7", "INV-8", "INV-10", "INV-11", "INV-12", "INV-13", "INV-14"])
def run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the rules of the daily runs, with the change of the run before as the headline, and of each account's newest regime."""
    state = written(daily_runs(spark, sf_dir), "runs")
    last = state.groupBy("plan").agg(F.max("day").alias("_last"))
    before = state.join(last, "plan").filter("day = _last - 1 and kind = 'change' and state = 'measured'")
    headline = last.select("plan").join(before.groupBy("plan").agg(F.max("at").alias("at")), "plan", "left")
    now = state.agg(F.max("day")).first()[0] or 0
    # what a message on the day of measuring said, from the size on that day
    first = state.filter("kind = 'change' and state = 'measured' and day = measured_on")
    lead = first.select("plan", "at", F.when(F.col("change_pct") > 0, "increased").otherwise("decreased").alias("direction"), F.abs(F.round("change_pct")).cast("int").alias("percent"))
    told = checks.state_rules(state, headline, now, LOOSE.hold_days, lead=lead)
    r, c = readings_and_changes(spark, sf_dir)
    direct = checks.direct_means_direct(written(regimes.cluster_regimes(c, r, ["account"], "click"), "regimes"), r, ["account"])
    return told.unionByName(direct.select(F.lit("direct_means_direct").alias("rule"), F.col("account").cast("string").alias("row")))


#: Instants at which the test tables' documents are published.
STORED_US, NOW_US = 1705276800000000, 1705881600000000


def published(at: int) -> str:
    """DuckDB's leaves of the documents published at an instant."""
    return f"""day_{at} AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY day) - 1 AS i FROM (SELECT account, end_us // 86400000000 AS day, sum(nano)::BIGINT AS nano, sum(delta_pct)::BIGINT AS pct, count(*) AS stretches FROM stretch_values WHERE end_us <= {at} GROUP BY ALL)),
model_{at} AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY model) - 1 AS i FROM (SELECT account, model, count(*) AS turns, sum(input)::BIGINT AS input FROM turns WHERE ts_us <= {at} GROUP BY ALL)),
who_{at} AS (SELECT account FROM day_{at} UNION SELECT account FROM model_{at}),
leaf_{at} AS (
  SELECT account AS id, 'generated_at' AS path, '{at}' AS value FROM who_{at} UNION ALL SELECT account, 'key', account::VARCHAR FROM who_{at}
  UNION ALL SELECT account, 'days[' || i || '].' || k, v::VARCHAR FROM (SELECT account, i, unnest(['day', 'nano', 'pct', 'stretches']) AS k, unnest([day, nano, pct, stretches]) AS v FROM day_{at})
  UNION ALL SELECT account, 'models[' || i || '].' || k, v FROM (SELECT account, i, unnest(['model', 'turns', 'input']) AS k, unnest(['"' || model || '"', turns::VARCHAR, input::VARCHAR]) AS v FROM model_{at})
  UNION ALL SELECT account, 'days', '[]' FROM who_{at} WHERE account NOT IN (SELECT account FROM day_{at}) UNION ALL SELECT account, 'models', '[]' FROM who_{at} WHERE account NOT IN (SELECT account FROM model_{at}))"""


def documents_at(spark: SparkSession, sf_dir: str, at: int) -> DataFrame:
    """Each account's document on what was known at an instant: its days of stretches and its models' turns."""
    s = stretch_values(spark, sf_dir).filter(F.col("end_us") <= at)
    days = s.groupBy("account", F.floor(F.col("end_us") / DAY).alias("day")).agg(F.sum("nano").alias("nano"), F.sum("delta_pct").cast("bigint").alias("pct"), F.count("*").alias("stretches"))
    models = turns(spark, sf_dir).filter(F.col("ts_us") <= at).groupBy("account", "model").agg(F.count("*").alias("turns"), F.sum("input").alias("input"))
    return documents.assemble({"days": days, "models": models}, "account", F.lit(at))


@query(VALUED + f", {published(NOW_US)} SELECT * FROM leaf_{NOW_US}", ["INV-15", "SET-6"])
def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the documents published at an instant."""
    return sets.document_leaves(documents_at(spark, sf_dir, NOW_US), "account", "document")


@query(VALUED + f", {published(STORED_US)}, {published(NOW_US)} SELECT id, path, a.value AS old, b.value AS new FROM leaf_{STORED_US} a FULL JOIN leaf_{NOW_US} b USING (id, path) WHERE a.value IS DISTINCT FROM b.value", ["INV-16", "INV-17", "SET-4", "SET-5"])
def rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leaves of the documents stored a week before differ from those rebuilt now."""
    return documents.rebuilt_diff(documents_at(spark, sf_dir, STORED_US), documents_at(spark, sf_dir, NOW_US), "account")


@query(""", k AS (SELECT account, ts_us // 86400000000 AS day, model, event_id % 2 = 1 AS wide, sum(input)::DOUBLE AS i, sum(output)::DOUBLE AS o, sum(cache_read)::DOUBLE AS r, sum(cache_write)::DOUBLE AS w FROM turns GROUP BY ALL),
d AS (SELECT account, day, count(*) AS n, sum(i) AS i, count(*) FILTER (WHERE model = 'click' AND NOT wide) AS bare, count(*) FILTER (WHERE model = 'click') AS own, coalesce(sum(i) FILTER (WHERE model = 'click'), 0) AS ci, coalesce(sum(o) FILTER (WHERE model = 'click'), 0) AS co, coalesce(sum(r) FILTER (WHERE model = 'click'), 0) AS cr, coalesce(sum(w) FILTER (WHERE model = 'click'), 0) AS cw,
  count(*) FILTER (WHERE model = 'click' AND (day % 3 = 0 OR (day % 3 = 1 AND wide))) AS priced FROM k GROUP BY ALL),
p AS (SELECT *, CASE WHEN day % 11 = 0 THEN 'error result: stopped' WHEN own = 0 THEN 'no usage for click' END AS problem FROM d)
SELECT account, day, problem, CASE WHEN problem IS NULL THEN CASE WHEN bare > 0 THEN 'click' ELSE 'click[1m]' END END AS model, CASE WHEN problem IS NULL THEN ci::BIGINT END AS input, CASE WHEN problem IS NULL THEN co::BIGINT END AS output, CASE WHEN problem IS NULL THEN cr::BIGINT END AS cache_read, CASE WHEN problem IS NULL THEN cw::BIGINT END AS cache_write,
  CASE WHEN problem IS NULL THEN CASE WHEN priced = 0 THEN i WHEN priced = own THEN ci END END AS cost_usd, CASE WHEN problem IS NULL THEN n * 125 / 1000.0::DOUBLE END AS seconds FROM p""", ["PRJ-55"])
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's day as a run's JSON result, parsed: keys of one model with and without a suffix, costs that all, some or no keys have, and errors."""
    day = F.floor(F.col("ts_us") / DAY)
    wide = F.col("event_id") % 2 == 1
    k = turns(spark, sf_dir).groupBy("account", day.alias("day"), F.concat("model", F.when(wide, "[1m]").otherwise("")).alias("key"), wide.alias("wide")).agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")])
    priced = (F.col("day") % 3 == 0) | ((F.col("day") % 3 == 1) & F.col("wide"))
    usage = F.struct(F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), F.col("cache_read").alias("cacheReadInputTokens"), F.col("cache_write").alias("cacheCreationInputTokens"), F.when(priced, F.col("input")).alias("costUSD"))
    d = k.groupBy("account", "day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", usage.alias("usage"))))).alias("modelUsage"), F.sum("input").alias("total_cost_usd"), (F.count("*") * 125).alias("duration_ms"))
    stopped = F.col("day") % 11 == 0
    text = F.to_json(F.struct(stopped.alias("is_error"), F.when(stopped, "stopped").alias("result"), "modelUsage", "total_cost_usd", "duration_ms"))
    return d.select("account", "day", V.run_result(text, F.lit("click")).alias("r")).select("account", "day", "r.*")
