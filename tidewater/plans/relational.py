"""Roll-ups, analytic functions, top-k and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import DAY, HOUR
from tidewater.operators import rollup, sets, windows
from tidewater.plans.base import events, query, readings, table, turns
from tidewater.plans.metering import VALUED, stretch_values, usd_per_pct_daily


@query("""WITH m AS (SELECT l_returnflag, l_quantity AS v, sum(l_linenumber)::BIGINT AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total, lead(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS nxt FROM m)
SELECT l_returnflag, arg_min(CASE WHEN 2 * cum = total THEN (v + coalesce(nxt, v)) / 2 ELSE v END, v) AS weighted_median FROM c WHERE 2 * cum >= total GROUP BY ALL""", ["AGG-21"], views=False)
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query("""WITH m AS (SELECT l_linestatus, l_quantity AS v, sum(l_linenumber)::BIGINT AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_linestatus ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_linestatus) AS total FROM m)
SELECT l_linestatus, min(v) AS weighted_median FROM c WHERE 2 * cum >= total GROUP BY ALL""", ["AGG-22"], views=False)
def weighted_median_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weighted_median(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_linenumber", midpoint=False)


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY ALL)
SELECT event_type, count(*) AS n, any_value(m) AS median, (max(value) - min(value)) / 2 / any_value(m) AS half_range_rel, 1.4826::DOUBLE * median(abs(value - m)) / any_value(m) AS mad_rel, round(stddev_samp(value) / avg(value), 9) AS cv
FROM events JOIN m USING (event_type) GROUP BY event_type""", ["AGG-4", "STAT-27", "AGG-55"], views=False)
def spread_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollup.spread(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.withColumn("cv", F.round("cv", 9))


@query("""WITH u AS (SELECT event_type, user_id, median(value) AS m, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, median(m) AS median, CASE WHEN count(*) >= 2 AND median(m) <> 0 THEN (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / quantile_cont(m, 0.5) END AS spread, count(*) AS units, sum(n)::BIGINT AS n FROM u GROUP BY ALL""", ["AGG-19", "AGG-20", "AGG-25", "AGG-33"], views=False)
def contributor_median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.median_of_medians(table(spark, sf_dir, "events"), ["event_type"], "user_id", "value")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, median(value) AS median, max(CASE WHEN i = n // 4 THEN value END) AS p25, max(CASE WHEN i = 3 * n // 4 THEN value END) AS p75, min(value) AS min, max(value) AS max FROM r GROUP BY event_type""", ["AGG-52", "AGG-11", "AGG-42"], views=False)
def index_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.index_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")


HIST = ", h AS (SELECT account, ts_us // 86400000000 AS day, event_type, floor(ln(cents) / ln(1.02))::BIGINT AS bin, count(*) AS n FROM e WHERE cents > 0 GROUP BY ALL)"


@query(HIST + "SELECT account, day, event_type, bin, n FROM h", ["AGG-26", "PRJ-44"])
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / DAY))
    return rollup.histogram(e, ["account", "day", "event_type"], F.col("cents"))


@query(HIST + """, p AS (SELECT event_type, bin, sum(n) AS n FROM h GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM p)
SELECT event_type, any_value(total)::BIGINT AS n,
  round(arg_min(CASE WHEN cum >= 0.5 * total THEN pow(1.02::DOUBLE, bin + (0.5 * total - (cum - n))::DOUBLE / n) END, CASE WHEN cum >= 0.5 * total THEN bin END), 6) AS median,
  round(arg_min(CASE WHEN cum >= 0.25 * total THEN pow(1.02::DOUBLE, bin + (0.25 * total - (cum - n))::DOUBLE / n) END, CASE WHEN cum >= 0.25 * total THEN bin END), 6) AS q1 FROM c GROUP BY event_type""", ["AGG-27", "AGG-28", "AGG-29"])
def log_hist_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from merged daily histograms, geometric inside a bin."""
    daily = log_histogram(spark, sf_dir)
    q = rollup.histogram_quantiles(rollup.merged_histograms(daily, ["event_type"]), ["event_type"], {"median": 0.5, "q1": 0.25})
    return q.select("event_type", "n", F.round("median", 6).alias("median"), F.round("q1", 6).alias("q1"))


@query("""SELECT event_type, account, entry, day, count(*) AS n, sum(cents)::BIGINT AS cents, GROUPING(account)::INT AS all_accounts, GROUPING(entry)::INT AS all_entries
FROM (SELECT *, k % 2 AS entry, ts_us // 86400000000 AS day FROM e) GROUP BY GROUPING SETS ((event_type, day), (event_type, account, day), (event_type, entry, day), (event_type, account, entry, day)) HAVING count(*) >= 30""", ["AGG-30"])
def speed_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"entry": F.col("k") % 2, "day": F.floor(F.col("ts_us") / DAY)})
    sets_ = [[F.col(c) for c in s] for s in (("event_type", "day"), ("event_type", "account", "day"), ("event_type", "entry", "day"), ("event_type", "account", "entry", "day"))]
    out = e.groupingSets(sets_, "event_type", "account", "entry", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.grouping("account").cast("int").alias("all_accounts"), F.grouping("entry").cast("int").alias("all_entries"))
    return out.filter("n >= 30")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts DESC, event_id) AS rk FROM events),
t AS (SELECT event_id, user_id, ts FROM r WHERE rk = 1 ORDER BY ts DESC, event_id LIMIT 2000)
SELECT event_id, epoch_us(ts) AS ts_us, substr(sha256('contrib:' || user_id), 1, 8) AS who FROM t""", ["AGG-24", "TOP-1", "TOP-7"], views=False)
def hourly_latest_top2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each user and hour; the 2,000 newest of those, under a pseudonym."""
    e = events(spark, sf_dir).select("event_id", "user_id", "ts_us")
    newest = windows.newest_each(e, ["user_id"], "ts_us", HOUR, ["event_id"]).orderBy(F.desc("ts_us"), "event_id").limit(2000)
    return newest.select("event_id", "ts_us", F.substring(F.sha2(F.concat(F.lit("contrib:"), F.col("user_id")), 256), 1, 8).alias("who"))


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, greatest(0, least(i - 4, n - 9)) AS lo FROM o), j AS (SELECT f.user_id, f.event_id, median(g.value) AS running_median FROM f JOIN o g ON g.user_id = f.user_id AND g.i >= f.lo AND g.i < f.lo + 9 GROUP BY ALL),
m AS (SELECT median(value) AS m FROM o)
SELECT user_id, event_id, running_median, running_median >= 1.6 * m AS fast FROM j, m""", ["WIN-1", "FLT-3"], views=False)
def fast_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose nine nearest in their session run at 1.6 times the overall median or more."""
    e = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id").filter("event_type = 'click'")
    run = windows.clamped_median(e, ["user_id"], ["ts_us", "event_id"], "value", 9)
    level = e.agg(F.median("value").alias("m"))
    return run.crossJoin(F.broadcast(level)).select("user_id", "event_id", "running_median", (F.col("running_median") >= 1.6 * F.col("m")).alias("fast"))


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase'),
j AS (SELECT a.user_id, a.event_id, a.value, median(b.value) AS previous_median FROM o a JOIN o b ON a.user_id = b.user_id AND b.i >= a.i - 4 AND b.i < a.i GROUP BY ALL)
SELECT user_id, event_id, previous_median, value / previous_median - 1 AS drift FROM j WHERE abs(value / previous_median - 1) > 0.15""", ["WIN-2", "AGG-45", "AGG-46", "AGG-47"], views=False)
def rolling_prev4_median_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    # a median of 0 gives infinity, or nan for 0, as the SQL has it; Spark's own division by 0 is an error
    ratio = F.when(F.col("previous_median") == 0, F.col("value") * F.lit(float("inf"))).otherwise(F.col("value") / F.col("previous_median"))
    out = windows.previous_median(e, ["user_id"], ["ts", "event_id"], "value").withColumn("drift", ratio - 1)
    return out.filter("previous_median is not null and abs(drift) > 0.15").select("user_id", "event_id", "previous_median", "drift")


DAILY = ", d AS (SELECT account, ts_us // 86400000000 AS day, sum(cents)::BIGINT AS num, sum(k)::BIGINT AS den FROM e GROUP BY ALL)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("account", F.floor(F.col("ts_us") / DAY).alias("day")).agg(F.sum("cents").alias("num"), F.sum("k").alias("den"))


@query(DAILY + "SELECT account, day, sum(num) OVER w::DOUBLE / sum(den) OVER w AS level FROM d WINDOW w AS (PARTITION BY account ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)", ["WIN-3", "AGG-38", "FLT-20"])
def trailing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_level(daily(spark, sf_dir), ["account"], "day", "num", "den").select("account", "day", "level")


@query(DAILY + """, l AS (SELECT *, (sum(num) OVER w - num)::DOUBLE / nullif(sum(den) OVER w - den, 0) AS level FROM d WINDOW w AS (PARTITION BY account ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING))
SELECT account, round(median(pow(num - level * den, 2) / den), 6) AS noise, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY account""", ["WIN-4", "STAT-10"])
def local_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.local_noise(daily(spark, sf_dir), ["account"], "day", "num", "den").select("account", F.round("noise", 6).alias("noise"), "n")


@query(DAILY + "SELECT account, day, (num::DOUBLE / den) / (sum(num) OVER (PARTITION BY account)::DOUBLE / sum(den) OVER (PARTITION BY account)) AS relative FROM d", ["WIN-5", "WIN-9"])
def relative_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.relative_to_own(daily(spark, sf_dir), ["account"], "num", "den").select("account", "day", "relative")


@query(DAILY + ", l AS (SELECT *, lag(num) OVER (PARTITION BY account ORDER BY day) AS b FROM d) SELECT account, round(corr(b::DOUBLE, num::DOUBLE), 6) AS lag1, count(*) AS n FROM l GROUP BY account HAVING count(*) >= 6", ["WIN-8"])
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.lag_correlation(daily(spark, sf_dir), ["account"], ["day"], "num")
    return out.select("account", F.round("lag1", 6).alias("lag1"), "n")


@query(", u AS (SELECT account, floor((ts_us - 1705000000000000)::DOUBLE / 86400000000)::BIGINT AS unit, sum(cents)::BIGINT AS cents, sum(k)::BIGINT AS k FROM e GROUP BY ALL) SELECT * FROM u", ["AGG-56", "AGG-57", "AGG-17"])
def aligned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over 24-hour units counted from one instant."""
    return windows.day_units(events(spark, sf_dir), ["account"], "ts_us", 1_705_000_000_000_000, ["cents", "k"])


@query(DAILY + """, g AS (SELECT account, day // 7 AS regime, sum(num)::DOUBLE / sum(den) AS level FROM d GROUP BY ALL),
s AS (SELECT *, 1 + (regime % 3) / 10.0 AS size FROM g)
SELECT account, regime, round(first_value(level) OVER (PARTITION BY account ORDER BY regime DESC) / exp(coalesce(sum(ln(size::DOUBLE)) OVER (PARTITION BY account ORDER BY regime DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 9) AS chained FROM s""", ["WIN-6", "WIN-7", "AGG-37", "AGG-39"])
def regime_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels carried back from the newest regime by the size of each step."""
    g = daily(spark, sf_dir).groupBy("account", F.floor(F.col("day") / 7).alias("regime")).agg((F.sum("num") / F.sum("den")).alias("level"))
    g = g.withColumn("size", 1 + (F.col("regime") % 3) / 10.0)
    return rollup.chained_back(g, ["account"], "regime", "size", "level").select("account", "regime", F.round("chained", 9).alias("chained"))


@query(VALUED + """, r AS (SELECT account, (start_us >= 1705276800000000)::INT AS regime, nano / 1e11 / delta_pct AS rate FROM stretch_values WHERE nano > 0),
u AS (SELECT regime, account, median(rate) AS m FROM r GROUP BY ALL), e2 AS (SELECT regime, min(m) AS lo, max(m) AS hi, count(*) AS units FROM u GROUP BY ALL)
SELECT regime, median(rate) AS median, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(units) AS units FROM r JOIN e2 USING (regime) GROUP BY regime""", ["AGG-31", "AGG-32", "AGG-33", "AGG-35", "AGG-53"])
def regime_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir).filter("nano > 0").withColumn("rate", F.col("nano") / F.lit(1e11) / F.col("delta_pct"))
    s = s.withColumn("regime", (F.col("start_us") >= 1705276800000000).cast("int"))
    return rollup.pooled_minmax(s, ["regime"], "account", "rate")


@query(VALUED + """, d AS (SELECT account, end_us // 86400000000 AS day, sum(nano) / 1e11 / sum(delta_pct) AS usd_per_pct FROM stretch_values GROUP BY ALL)
SELECT account, median(usd_per_pct) FILTER (WHERE day < 19738 AND day >= 19724) AS before, median(usd_per_pct) FILTER (WHERE day >= 19738 AND day < 19752) AS after,
  median(usd_per_pct) FILTER (WHERE day >= 19738 AND day < 19752) / median(usd_per_pct) FILTER (WHERE day < 19738 AND day >= 19724) AS ratio FROM d GROUP BY account""", ["AGG-43", "AGG-9"])
def two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.two_sides(usd_per_pct_daily(spark, sf_dir), ["account"], "day", 19738, "usd_per_pct")


@query("""SELECT account, model, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM turns
WHERE ts_us >= 1705276800000000 AND ts_us <= 1705881600000000 GROUP BY ALL""", ["AGG-49"])
def contrib_tokens_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each model in a closed span of time."""
    t = turns(spark, sf_dir).filter(F.col("ts_us").between(1705276800000000, 1705881600000000))
    return t.groupBy("account", "model").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")])


@query(VALUED + """, f AS (SELECT s.account, s.ordinal, sum(CASE WHEN t.model = 'click' THEN t.input ELSE 0 END)::BIGINT AS click, sum(CASE WHEN t.model = 'error' THEN t.input ELSE 0 END)::BIGINT AS error,
 sum(CASE WHEN t.model = 'purchase' THEN t.input ELSE 0 END)::BIGINT AS purchase FROM stretches s JOIN stretch_turns t USING (account, ordinal) GROUP BY ALL)
SELECT *, CASE WHEN click >= 0.8 * (click + error + purchase) THEN 'click' WHEN error >= 0.8 * (click + error + purchase) THEN 'error' WHEN purchase >= 0.8 * (click + error + purchase) THEN 'purchase' END AS dominant FROM f WHERE click + error + purchase > 0""", ["AGG-50", "AGG-51", "FLT-23", "AGG-58"])
def family_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of tokens for each family of a stretch, and the one that dominates it."""
    from tidewater.plans.metering import closed_stretches, turns_in_stretches

    names = ["click", "error", "purchase"]
    t = turns_in_stretches(spark, sf_dir).join(closed_stretches(spark, sf_dir).select("account", "ordinal"), ["account", "ordinal"])
    p = t.groupBy("account", "ordinal").pivot("model", names).agg(F.sum("input")).na.fill(0, names)
    whole = sum((F.col(c) for c in names), F.lit(0))
    top = F.coalesce(*[F.when(F.col(c) >= 0.8 * whole, c) for c in names])
    return p.filter(whole > 0).withColumn("dominant", top)


@query("SELECT account, arg_min(model, (ts_us, event_id)) AS first_model, min(ts_us) AS first_us, count(DISTINCT model) AS models FROM turns GROUP BY account", ["AGG-34", "STAT-31", "TOP-6"])
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("account").agg(F.min_by("model", F.struct("ts_us", "event_id")).alias("first_model"), F.min("ts_us").alias("first_us"), F.count_distinct("model").alias("models"))


@query("""SELECT account, model AS family FROM (SELECT account, model, count(*) AS n FROM turns GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY account ORDER BY n DESC, model <> 'click', model) = 1""", ["TOP-4", "TOP-2", "TOP-3"])
def regime_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent model of each account; a named one wins ties, then the name."""
    n = turns(spark, sf_dir).groupBy("account", "model").agg(F.count("*").alias("n"))
    w = W.partitionBy("account").orderBy(F.desc("n"), F.col("model") != "click", "model")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("account", F.col("model").alias("family"))


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS click_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS purchase_id FROM e GROUP BY user_id HAVING click_id IS NOT NULL AND purchase_id IS NOT NULL""", ["AGG-48"])
def latest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    return e.groupBy("user_id").agg(of("click").alias("click_id"), of("purchase").alias("purchase_id")).na.drop()


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT user_id, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS "is" FROM a FULL JOIN b USING (user_id) WHERE coalesce(a.n, 0) - coalesce(b.n, 0) >= 0.05 * coalesce(a.n, 0) AND coalesce(a.n, 0) - coalesce(b.n, 0) >= 5""", ["AGG-44"], views=False)
def transcript_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with at least 5 % and 5 fewer events in the second half."""
    e = table(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
    return rollup.fell(count(e.filter(F.col("ts") < half)), count(e.filter(F.col("ts") >= half)), ["user_id"], "n", 0.05, 5)


@query("""WITH a AS (SELECT n_nationkey AS key, n_regionkey AS v FROM nation), b AS (SELECT n_nationkey + 2 AS key, n_regionkey AS v FROM nation)
SELECT key, a.v AS old, b.v AS new, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v""", [], views=False)
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("v"))
    return sets.table_diff(n, n.withColumn("key", F.col("key") + 2), ["key"], "v")


@query("""SELECT n_nationkey AS id, 'name' AS path, '"' || n_name || '"' AS value FROM nation UNION ALL SELECT n_nationkey, 'where.region', n_regionkey::VARCHAR FROM nation UNION ALL SELECT n_nationkey, 'list[' || i || ']', (n_nationkey * i)::VARCHAR FROM nation, range(3) r(i)""", [], views=False)
def document_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents built from rows, flattened to (path, scalar)."""
    n = table(spark, sf_dir, "nation")
    doc = F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("where"), F.array(*[F.col("n_nationkey") * i for i in range(3)]).alias("list")))
    return sets.document_leaves(n.select("n_nationkey", doc.alias("doc")), "n_nationkey", "doc")


@query("""WITH a AS (SELECT r_regionkey AS id, r_name AS name, r_regionkey * 1.0 AS v FROM region), b AS (SELECT r_regionkey AS id, CASE WHEN r_regionkey = 2 THEN 'X' ELSE r_name END AS name, r_regionkey AS v FROM region WHERE r_regionkey <> 4)
SELECT id, 'name' AS path, '"' || a.name || '"' AS old, CASE WHEN b.name IS NOT NULL THEN '"' || b.name || '"' END AS new FROM a LEFT JOIN b USING (id) WHERE a.name IS DISTINCT FROM b.name
UNION ALL SELECT id, 'v', '4.0', NULL FROM a WHERE id = 4""", [], views=False)
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that differ between published and rebuilt documents; 1 equals 1.0."""
    r = table(spark, sf_dir, "region")
    doc = lambda name, v: F.to_json(F.struct(name.alias("name"), v.alias("v")))
    a = r.select(F.col("r_regionkey").alias("id"), doc(F.col("r_name"), F.col("r_regionkey").cast("double")).alias("doc"))
    b = r.filter("r_regionkey <> 4").select(F.col("r_regionkey").alias("id"), doc(F.when(F.col("r_regionkey") == 2, "X").otherwise(F.col("r_name")), F.col("r_regionkey")).alias("doc"))
    return sets.document_diff(sets.document_leaves(a, "id", "doc"), sets.document_leaves(b, "id", "doc"))


@query("""SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000""", ["SET-1"], views=False)
def accounts_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return sets.in_both(s, c, ["k"])


@query("""SELECT account, iso_end, sum(five_hour)::BIGINT AS num, sum(seven_day)::BIGINT AS den, sum(five_hour) / sum(seven_day) AS ratio, count(*) AS points
FROM (SELECT *, epoch(date_trunc('week', make_timestamp(ts_us)) + INTERVAL 6 DAY)::BIGINT // 86400 AS iso_end FROM readings) GROUP BY ALL HAVING sum(seven_day) > 0""", ["AGG-36", "AGG-14", "AGG-23", "PRJ-36"])
def pooled_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.functions.values import iso_week_ending

    r = readings(spark, sf_dir).select("account", iso_week_ending(F.col("ts_us")).alias("iso_end"), F.col("five_hour").cast("bigint").alias("num"), F.col("seven_day").cast("bigint").alias("den"))
    return rollup.ratio_of_sums(r, ["account", "iso_end"], "num", "den").filter("den > 0")
