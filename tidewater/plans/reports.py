"""Published figures over the meter views: rates in force, series ends, sources of resets, audits and document rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater import checks
from tidewater.functions import values as V
from tidewater.operators import asof, ordered, rollup
from tidewater.plans.base import FIVE_HOURS, HOUR, MAX_GAP, prices, query, readings, table, turns
from tidewater.plans.metering import POINTS, VALUED, closed_stretches, stretch_values, turns_in_stretches, valued
from tidewater.plans.relational import DAILY, daily
from tidewater.stats import changes

ANCHOR = "click"
CUT_US = 1705276800000000


@query(""", u AS (SELECT account, model, sum(input)::DOUBLE / sum(output) AS v FROM turns GROUP BY ALL),
q AS (SELECT t.account, t.model, t.v / b.v AS ratio FROM u t JOIN u b ON b.account = t.account AND b.model = 'click' WHERE t.model <> 'click'),
m AS (SELECT model, median(ratio) AS rate, min(ratio) AS lo, max(ratio) AS hi FROM q GROUP BY model HAVING count(*) >= 2)
SELECT p.model, p_input::DOUBLE / 3000 AS list_ratio, CASE WHEN p.model = 'click' THEN 1.0::DOUBLE ELSE coalesce(m.rate, p_input::DOUBLE / 3000) END AS rate,
  CASE WHEN p.model = 'click' THEN 'anchor' WHEN m.rate IS NOT NULL THEN 'measured' ELSE 'list' END AS rate_source, CASE WHEN p.model <> 'click' THEN m.lo * 2 END AS lo, CASE WHEN p.model <> 'click' THEN m.hi * 3 END AS hi,
  meter_weight / 100.0::DOUBLE AS class_weight
FROM prices p LEFT JOIN m ON p.model = m.model WHERE p.model IN (SELECT DISTINCT model FROM turns)""", ["PRJ-12", "PRJ-20", "PRJ-24", "PRJ-26", "PRJ-48", "PRJ-49"])
def rates_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of each model in use: the anchor's is 1, then the median over accounts of input a token against the anchor's, then the list price over the anchor's.

    One account alone does not measure a rate; intervals are the accounts' least and largest, scaled by a ratio's ends.
    """
    p, t = prices(spark), turns(spark, sf_dir)
    anchor = p.filter(F.col("model") == ANCHOR).select(F.col("p_input").alias("_anchor"))
    u = t.groupBy("account", "model").agg((F.sum("input").cast("double") / F.sum("output")).alias("v"))
    q = u.filter(F.col("model") != ANCHOR).join(u.filter(F.col("model") == ANCHOR).select("account", F.col("v").alias("_b")), "account").withColumn("ratio", F.col("v") / F.col("_b"))
    measured = q.groupBy("model").agg(F.median("ratio").alias("rate"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), F.count("*").alias("_n")).filter("_n >= 2").drop("_n")
    out = p.join(u.select("model").distinct(), "model").crossJoin(F.broadcast(anchor)).join(measured, "model", "left")
    first, listed = F.col("model") == ANCHOR, F.col("p_input").cast("double") / F.col("_anchor")
    scaled = V.scaled_interval(F.col("rate"), F.col("lo"), F.col("hi"), F.lit(2.5), F.lit(2.0), F.lit(3.0))
    source = F.when(first, "anchor").when(F.col("rate").isNotNull(), "measured").otherwise("list")
    return out.select("model", listed.alias("list_ratio"), F.when(first, 1.0).otherwise(F.coalesce("rate", listed)).alias("rate"), source.alias("rate_source"), F.when(~first, scaled["lo"]).alias("lo"), F.when(~first, scaled["hi"]).alias("hi"), (F.col("meter_weight") / 100).alias("class_weight"))


@query(""", t AS (
  SELECT account, ts_us // 18000000000 AS win, model, sum(input + output + cache_read + cache_write)::BIGINT AS tokens,
         sum((input * p_input + output * p_output + cache_read * p_read + cache_write * p_write + cache_write_1h * (p_write_1h - p_write)) * meter_weight)::BIGINT AS nano
  FROM turns JOIN prices USING (model) GROUP BY ALL),
r AS (SELECT account, ts_us // 18000000000 AS win, max(five_hour) AS pct FROM readings GROUP BY ALL HAVING max(five_hour) >= 5)
SELECT account, win, model, tokens / (pct * nano / sum(nano) OVER (PARTITION BY account, win)) AS tokens_per_pct, nano / sum(nano) OVER (PARTITION BY account, win) AS share
FROM t JOIN r USING (account, win) QUALIFY nano / sum(nano) OVER (PARTITION BY account, win) >= 0.05 AND pct * nano / sum(nano) OVER (PARTITION BY account, win) >= 5""", ["PRJ-42", "PRJ-51"])
def window_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per percent of each model in each five-hour window, by its share of the value; small movements are left out."""
    win = F.floor(F.col("ts_us") / FIVE_HOURS).alias("win")
    t = valued(spark, turns(spark, sf_dir)).filter("nano is not null")
    t = t.groupBy("account", win, "model").agg(F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens"), F.sum("nano").alias("nano"))
    moved = readings(spark, sf_dir).groupBy("account", win).agg(F.max("five_hour").alias("pct")).filter("pct >= 5")
    out = t.withColumn("share", F.col("nano") / F.sum("nano").over(W.partitionBy("account", "win"))).join(moved, ["account", "win"])
    own = F.col("pct") * F.col("share")
    return out.filter((F.col("share") >= 0.05) & (own >= 5)).select("account", "win", "model", (F.col("tokens") / own).alias("tokens_per_pct"), "share")


@query(""", l AS (SELECT account, max(ts_us) FILTER (WHERE five_hour > 0) AS last_five, max(ts_us) AS newest FROM readings GROUP BY account),
s AS (SELECT account, min(r.ts_us) AS weekly_only_since FROM readings r JOIN l USING (account) WHERE r.ts_us > l.last_five GROUP BY account),
f AS (SELECT l.*, weekly_only_since, coalesce(newest - weekly_only_since >= 21600000000, false) AS switched FROM l LEFT JOIN s USING (account))
SELECT *, min(last_five) FILTER (WHERE switched) OVER () AS series_end FROM f""", ["SCAN-11", "SCAN-11b", "SCAN-11c"])
def series_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose five-hour meter has ended, and the end of the shared series: one row an account."""
    r = readings(spark, sf_dir)
    last = r.groupBy("account").agg(F.max(F.when(F.col("five_hour") > 0, F.col("ts_us"))).alias("last_five"), F.max("ts_us").alias("newest"))
    since = r.join(last, "account").filter("ts_us > last_five").groupBy("account").agg(F.min("ts_us").alias("weekly_only_since"))
    out = last.join(since, "account", "left").withColumn("switched", F.coalesce(F.col("newest") - F.col("weekly_only_since") >= 6 * HOUR, F.lit(False)))
    end = out.filter("switched").agg(F.min("last_five").alias("series_end"))
    return out.crossJoin(F.broadcast(end))


@query(""", q AS (SELECT *, seq % 5 = 0 AS inferred, seq % 11 = 0 AS logged FROM readings)
SELECT s.account, s.ordinal, count(q.seq) AS n, CASE WHEN bool_or(logged) THEN 'logged' WHEN bool_or(inferred) THEN 'inferred' ELSE 'none' END AS reset_source
FROM stretches s LEFT JOIN q ON q.account = s.account AND q.ts_us BETWEEN s.start_us AND s.end_us GROUP BY ALL""", ["AGG-10"])
def reset_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the resets inside a stretch, both ends counted, come from."""
    q = readings(spark, sf_dir).select(F.col("account").alias("_account"), "ts_us", "seq", (F.col("seq") % 5 == 0).alias("inferred"), (F.col("seq") % 11 == 0).alias("logged"))
    s = closed_stretches(spark, sf_dir).select("account", "ordinal", "start_us", "end_us")
    inside = asof.overlapping(s, q.select(F.col("_account").alias("account"), "ts_us", F.col("ts_us").alias("at_us"), "seq", "inferred", "logged"), ["account"], ("start_us", "end_us"), ("ts_us", "at_us"), 12 * HOUR, closed=True)
    both = s.join(inside.select("account", "ordinal", "seq", "inferred", "logged"), ["account", "ordinal"], "left")
    source = F.when(F.bool_or("logged"), "logged").when(F.bool_or("inferred"), "inferred").otherwise("none")
    return both.groupBy("account", "ordinal").agg(F.count("seq").alias("n"), source.alias("reset_source"))


@query("""SELECT s.account, s.ordinal, min(r.ts_us) FILTER (WHERE r.ts_us >= s.start_us + 3600000000) AS first_us, min(r.ts_us) FILTER (WHERE r.ts_us > s.end_us) AS next_us
FROM stretches s LEFT JOIN readings r ON r.account = s.account AND r.ts_us >= s.start_us + 3600000000 AND r.ts_us <= s.end_us + 86400000000 GROUP BY ALL""", ["INT-10"])
def run_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's first reading after its begin and the next one beyond its end, within a day."""
    r = readings(spark, sf_dir).select("account", "ts_us", F.col("ts_us").alias("at_us"))
    s = closed_stretches(spark, sf_dir).select("account", "ordinal", "start_us", "end_us", (F.col("start_us") + HOUR).alias("from_us"), (F.col("end_us") + 24 * HOUR).alias("to_us"))
    near = asof.overlapping(s, r, ["account"], ("from_us", "to_us"), ("ts_us", "at_us"), 24 * HOUR, closed=True)
    return s.join(near.select("account", "ordinal", "ts_us"), ["account", "ordinal"], "left").groupBy("account", "ordinal").agg(F.min(F.when(F.col("ts_us") >= F.col("start_us") + HOUR, F.col("ts_us"))).alias("first_us"), F.min(F.when(F.col("ts_us") > F.col("end_us"), F.col("ts_us"))).alias("next_us"))


@query(VALUED + """, m AS (SELECT account, ordinal, sum(CASE WHEN output > 300 THEN nano END) AS heavy, sum(nano) AS nano FROM valued WHERE nano IS NOT NULL GROUP BY ALL)
SELECT s.account, s.ordinal, coalesce(m.nano, 0)::BIGINT AS nano, s.delta_pct * (1 + 0.53::DOUBLE * coalesce(m.heavy::DOUBLE / m.nano, 0)) AS weighted_pct FROM stretches s LEFT JOIN m USING (account, ordinal)""", ["AGG-16", "AGG-7"])
def weighted_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of each stretch, weighted up by the share of its value from long answers."""
    t = valued(spark, turns_in_stretches(spark, sf_dir)).filter("nano is not null")
    m = t.groupBy("account", "ordinal").agg(F.sum(F.when(F.col("output") > 300, F.col("nano"))).alias("heavy"), F.sum("nano").alias("nano"))
    out = closed_stretches(spark, sf_dir).join(m, ["account", "ordinal"], "left")
    share = F.coalesce(F.col("heavy").cast("double") / F.col("nano"), F.lit(0.0))
    return out.select("account", "ordinal", F.coalesce("nano", F.lit(0)).alias("nano"), (F.col("delta_pct") * (1 + F.lit(0.53) * share)).alias("weighted_pct"))


@query(VALUED + "SELECT account, count(*) AS runs, median(nano / delta_pct) AS nano_per_pct FROM stretch_values WHERE turns > 0 GROUP BY account", ["AGG-40"])
def median_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir).filter("turns > 0")
    return s.groupBy("account").agg(F.count("*").alias("runs"), F.median(F.col("nano") / F.col("delta_pct")).alias("nano_per_pct"))


@query(POINTS + "SELECT account, window_us, d5, d7, pieces FROM points WHERE nullif(pieces, 1) IS NOT NULL", ["FLT-15"])
def repaired_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window points that were joined over a gap: those that state a number of pieces."""
    p = ordered.window_points(readings(spark, sf_dir), MAX_GAP).withColumn("stated", F.nullif("pieces", F.lit(1)))
    return p.filter("stated is not null").select("account", "window_us", "d5", "d7", "pieces")


@query(DAILY + """, z AS (SELECT account, ln(num::DOUBLE / den) AS x FROM d WHERE num > 0 AND den > 0)
SELECT account, count(*) AS n, round(greatest(1, stddev_pop(x)), 9) AS coverage, round(stddev_pop(x), 9) AS spread FROM z GROUP BY account""", ["STAT-21"])
def null_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a line's null scores spread: the factor that widens its intervals, 1 at least."""
    z = daily(spark, sf_dir).filter("num > 0 and den > 0").select("account", F.log(F.col("num") / F.col("den")).alias("x"))
    return z.groupBy("account").agg(F.count("*").alias("n"), F.round(F.greatest(F.lit(1.0), F.stddev_pop("x")), 9).alias("coverage"), F.round(F.stddev_pop("x"), 9).alias("spread"))


@query(VALUED + f""", v AS (SELECT account, ordinal, delta_pct AS w, nano / delta_pct AS x, (start_us + end_us) // 2 < {CUT_US} AS early FROM stretch_values),
mm AS (SELECT account, x, sum(w) AS w FROM v GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY account ORDER BY x) AS cum, sum(w) OVER (PARTITION BY account) AS total, lead(x) OVER (PARTITION BY account ORDER BY x) AS nxt FROM mm),
wm AS (SELECT account, arg_min(CASE WHEN 2 * cum = total THEN (x + coalesce(nxt, x)) / 2 ELSE x END, x) AS middle FROM c WHERE 2 * cum >= total GROUP BY account)
SELECT account, early, sum(CASE WHEN x >= 0.1::DOUBLE * middle THEN w ELSE 0 END) / sum(w) AS captured, sum(CASE WHEN x >= 0.1::DOUBLE * middle THEN w ELSE 0 END) / sum(w) >= 0.9 AS passes FROM v JOIN wm USING (account) GROUP BY account, early""", ["STAT-24"])
def capture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each side of an instant, the share of meter movement with work worth a tenth of the account's weighted median."""
    s = stretch_values(spark, sf_dir)
    v = s.select("account", F.col("delta_pct").alias("w"), (F.col("nano") / F.col("delta_pct")).alias("x"), (F.floor((F.col("start_us") + F.col("end_us")) / 2) < CUT_US).alias("early"))
    middle = rollup.weighted_median(v, ["account"], "x", "w").withColumnRenamed("weighted_median", "middle")
    captured = F.sum(F.when(F.col("x") >= F.lit(0.1) * F.col("middle"), F.col("w")).otherwise(0)) / F.sum("w")
    return v.join(middle, "account").groupBy("account", "early").agg(captured.alias("captured")).withColumn("passes", F.col("captured") >= 0.9)


@query(VALUED + f""", f(factor) AS (VALUES (0.8::DOUBLE), (1.25::DOUBLE)), names AS (SELECT model, factor FROM prices, f),
t AS (SELECT s.account, s.ordinal, t.model, (s.start_us + s.end_us) // 2 < {CUT_US} AS early,
  (t.input * p_input + t.output * p_output + t.cache_read * p_read + t.cache_write * p_write + t.cache_write_1h * (p_write_1h - p_write)) * meter_weight AS nano FROM stretches s JOIN stretch_turns t USING (account, ordinal) JOIN prices USING (model)),
m AS (SELECT account, model, sum(nano) FILTER (WHERE early)::BIGINT AS a, sum(nano) FILTER (WHERE NOT early)::BIGINT AS b FROM t GROUP BY ALL),
w AS (SELECT account, sum(a) AS a, sum(b) AS b FROM m GROUP BY account HAVING sum(a) > 0 AND sum(b) > 0),
x AS (SELECT w.account, ln((w.b + (n.factor - 1) * coalesce(m.b, 0)) / (w.a + (n.factor - 1) * coalesce(m.a, 0))) - ln(w.b / w.a) AS move FROM w CROSS JOIN names n LEFT JOIN m ON m.account = w.account AND m.model = n.model)
SELECT account, round(sum(least(move, 0)), 9) AS falls, round(sum(greatest(move, 0)), 9) AS rises FROM x GROUP BY account""", ["STAT-23"])
def rate_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a step moves when each model's rate goes to either end of its interval: sums of falls and of rises."""
    t = valued(spark, turns_in_stretches(spark, sf_dir)).filter("nano is not null")
    sides = closed_stretches(spark, sf_dir).select("account", "ordinal", (F.floor((F.col("start_us") + F.col("end_us")) / 2) < CUT_US).alias("early"))
    m = t.join(sides, ["account", "ordinal"]).groupBy("account", "model").agg(F.sum(F.when(F.col("early"), F.col("nano"))).alias("a"), F.sum(F.when(~F.col("early"), F.col("nano"))).alias("b"))
    whole = m.groupBy("account").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b")).filter("all_a > 0 and all_b > 0")
    variants = prices(spark).select("model", F.explode(F.array(F.lit(0.8), F.lit(1.25))).alias("factor"))
    x = whole.crossJoin(F.broadcast(variants)).join(m, ["account", "model"], "left").na.fill(0, ["a", "b"])
    more = F.col("factor") - 1
    move = F.log((F.col("all_b") + more * F.col("b")) / (F.col("all_a") + more * F.col("a"))) - F.log(F.col("all_b") / F.col("all_a"))
    return x.withColumn("move", move).groupBy("account").agg(F.round(F.sum(F.least("move", F.lit(0.0))), 9).alias("falls"), F.round(F.sum(F.greatest("move", F.lit(0.0))), 9).alias("rises"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'candidate' WHEN n_regionkey < 3 THEN 'provisional' ELSE 'measured' END AS state FROM nation),
s AS (SELECT k FROM c WHERE k % 2 = 0), f AS (SELECT k // 4 AS change, k % 3 AS pct FROM c)
SELECT 'newest' AS rule, '7' AS row FROM (SELECT max(k) AS m FROM c WHERE state <> 'candidate') WHERE m <> 7
UNION ALL SELECT 'drawn', k || ':no step' FROM c WHERE state <> 'candidate' AND k NOT IN (SELECT k FROM s)
UNION ALL SELECT 'drawn', k || ':no stated change' FROM s WHERE k NOT IN (SELECT k FROM c WHERE state <> 'candidate')
UNION ALL SELECT 'one_figure', change::VARCHAR FROM f GROUP BY change HAVING count(DISTINCT pct) > 1
UNION ALL SELECT 'matched', coalesce(a.k, b.k) || CASE WHEN a.k IS NULL THEN ':no boundary' ELSE ':no change' END FROM s a FULL JOIN (SELECT k FROM c WHERE k % 3 = 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
UNION ALL SELECT 'names_hidden', 'changes.' || k FROM c WHERE regexp_matches(name, '\\b(CHINA|INDIA)\\b')
UNION ALL SELECT 'flag_iff', k::VARCHAR FROM c WHERE (k % 2 = 1) <> (state = 'provisional')""", ["INV-9"], views=False)
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a published document that break its rules; nations stand for changes."""
    region = F.col("n_regionkey")
    state = F.when(region == 0, "candidate").when(region < 3, "provisional").otherwise("measured")
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), state.alias("state"))
    steps, figures = c.filter("k % 2 = 0").select("k"), c.select(F.floor(F.col("k") / 4).alias("change"), (F.col("k") % 3).alias("pct"))
    told = lambda rule, df, row: df.select(F.lit(rule).alias("rule"), row.cast("string").alias("row"))
    problem = F.concat_ws(":", "k", "problem")
    found = [
        told("newest", checks.newest_stated(c, c.filter("k = 7").select("k"), "k"), F.col("k")),
        told("drawn", checks.drawn(c, steps, "k"), problem),
        told("one_figure", checks.one_figure(figures, "change", "pct"), F.col("change")),
        told("matched", checks.matched(steps, c.filter("k % 3 = 0"), "k"), problem),
        told("names_hidden", checks.names_hidden(c.select(F.concat(F.lit("changes."), "k").alias("path"), F.col("name").alias("value")), ["CHINA", "INDIA"]), F.col("path")),
        told("flag_iff", checks.flag_iff(c, F.col("k") % 2 == 1, F.col("state") == "provisional"), F.col("k")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query(""", q AS (SELECT account, ts_us, seq, five_hour, CASE WHEN account % 2 = 0 AND seq % 4 = 0 THEN resets_us END AS resets_us FROM readings),
l AS (SELECT *, lag(five_hour) OVER w AS was, lag(ts_us) OVER w AS was_ts FROM q WINDOW w AS (PARTITION BY account ORDER BY ts_us, seq)),
v AS (SELECT *, count(*) FILTER (WHERE five_hour <> was) OVER w AS level, count(*) FILTER (WHERE five_hour < was OR ts_us - was_ts > 18000000000) OVER w AS part FROM l WINDOW w AS (PARTITION BY account ORDER BY ts_us, seq)),
f AS (SELECT account, level, min(ts_us) AS level_from FROM v GROUP BY ALL),
o AS (SELECT v.account, v.part, v.ts_us + 18000000000 AS window_end FROM v JOIN f ON f.account = v.account AND f.level = v.level - 1 WHERE v.resets_us IS NULL AND v.five_hour < v.was AND v.ts_us - f.level_from <= 18000000000),
u AS (SELECT o.account, o.part, o.window_end FROM o JOIN v USING (account, part) WHERE v.ts_us < o.window_end GROUP BY ALL HAVING max(v.five_hour) > 0)
SELECT v.account, v.seq, coalesce(v.resets_us, CASE WHEN v.ts_us < u.window_end THEN u.window_end END) AS resets_us FROM v LEFT JOIN u ON u.account = v.account AND u.part = v.part""", ["SCAN-3"])
def inferred_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets of readings that state few of them, told from the meter's falls."""
    some = F.when((F.col("account") % 2 == 0) & (F.col("seq") % 4 == 0), F.col("resets_us"))
    return ordered.inferred_resets(readings(spark, sf_dir).withColumn("resets_us", some)).select("account", "seq", "resets_us")


@query(None, ["SCAN-4"])
def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each log in the longest run of lines whose stamps do not fall."""
    r = readings(spark, sf_dir).withColumns({"log_id": F.col("account").cast("string"), "line_no": F.col("seq")})
    return ordered.in_log_order(r)


@query(None, ["STAT-19", "STAT-20"])
def refined_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest instant of a daily grid, looked for again hour by hour within two days, until it stays: three passes at most."""
    units = daily(spark, sf_dir).select("account", (F.col("day") * 24.0 + 12).alias("t"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    return changes.refined(units, permutations=200)


@query(None, ["STAT-59"])
def detection_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a test of medians finds a step of a fifth in simulations drawn from each account's daily ratios."""
    ratios = daily(spark, sf_dir).filter("den > 0").select("account", (F.col("num") / F.col("den")).alias("x"))
    return changes.power_by(ratios, "account", "x", 1.2, 10, 2000, 5, changes.medians_apart)


