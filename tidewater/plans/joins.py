"""Joins, deduplication and merges over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.values import DAY, FIVE_HOURS, HOUR, MINUTE
from tidewater.operators import asof, dedupe, ordered, windows
from tidewater.plans.base import events, prices, query, readings, table, turns
from tidewater.plans.metering import closed_stretches, steps_of

# Spans of excluded work: a purchase with a large counter opens one of k times ten minutes.
RUNS = ", runs AS (SELECT account, event_id AS run, ts_us AS run_start_us, ts_us + k * 600000000 AS run_end_us, k FROM e WHERE event_type = 'purchase' AND k > 80)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'purchase' and k > 80")
    return e.select("account", F.col("event_id").alias("run"), F.col("ts_us").alias("run_start_us"), (F.col("ts_us") + F.col("k") * 10 * MINUTE).alias("run_end_us"), "k")


CLAIMS = ", claims AS (SELECT user_id, ts_us AS claim_us, 'g' || (k % 3) AS owner FROM e WHERE event_type = 'purchase')"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("ts_us").alias("claim_us"), F.concat(F.lit("g"), F.col("k") % 3).alias("owner"))


@query(CLAIMS + """, f AS (SELECT user_id, arg_min(owner, (claim_us, owner)) AS first_owner FROM claims GROUP BY user_id),
j AS (SELECT c.user_id, c.event_id, c.ts_us, a.owner FROM (SELECT * FROM e WHERE event_type = 'click') c ASOF LEFT JOIN claims a ON c.user_id = a.user_id AND c.ts_us >= a.claim_us)
SELECT j.user_id, event_id, coalesce(owner, first_owner) AS owner FROM j LEFT JOIN f USING (user_id)""", ["ASOF-2", "SRC-25"])
def owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = events(spark, sf_dir).filter("event_type = 'click'").select("user_id", "event_id", "ts_us")
    return asof.claim_owner(clicks, claims(spark, sf_dir), ["user_id"], "ts_us", "claim_us", "owner").drop("ts_us")


@query(CLAIMS + """, c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT account, ts_us AS p_us, event_id AS p_id, cents AS p_cents FROM e WHERE event_type = 'purchase')
SELECT c.account, c.event_id, p.p_id, p.p_cents FROM c ASOF LEFT JOIN p ON c.account = p.account AND c.ts_us >= p.p_us""", ["ASOF-1"])
def last_purchase_before_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup with the key's rows spread over daily buckets."""
    e = events(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").select("account", "event_id", "ts_us")
    bought = e.filter("event_type = 'purchase'").select("account", F.col("ts_us").alias("p_us"), F.col("event_id").alias("p_id"), F.col("cents").alias("p_cents"))
    return asof.asof_backward(clicks, bought, ["account"], "ts_us", "p_us", ["p_id", "p_cents"], ["p_id"], bucket=DAY).drop("ts_us")


@query(CLAIMS + " SELECT user_id, string_agg(claim_us || ':' || owner, ',' ORDER BY claim_us, owner) AS segments FROM claims GROUP BY user_id", ["ASOF-3"])
def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = asof.merged_claims(claims(spark, sf_dir), ["user_id"], "claim_us", "owner")
    return m.select("user_id", F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["t"], s["owner"])), ",").alias("segments"))


@query(RUNS + "SELECT s.account, s.ordinal, s.start_us, s.end_us, arg_min(run, (run_start_us, run)) AS run, count(*) AS n FROM stretches s JOIN runs r ON r.account = s.account AND s.start_us < run_end_us AND run_start_us < s.end_us GROUP BY ALL", ["INT-6", "INT-9"])
def overlapping_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run that each stretch overlaps, and how many do."""
    s = closed_stretches(spark, sf_dir).select("account", "ordinal", "start_us", "end_us")
    hits = asof.overlapping(s, runs(spark, sf_dir), ["account"], ("start_us", "end_us"), ("run_start_us", "run_end_us"), 12 * HOUR)
    return hits.groupBy("account", "ordinal", "start_us", "end_us").agg(F.min_by("run", F.struct("run_start_us", "run")).alias("run"), F.count("*").alias("n"))


@query(RUNS + "SELECT account, ordinal, start_us, end_us, delta_pct FROM stretches s WHERE delta_pct >= 12 AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.account = s.account AND s.start_us < run_end_us AND run_start_us < s.end_us)", ["ANTI-1", "FLT-6", "FLT-7", "FLT-8", "FLT-9", "FLT-12", "FLT-16"])
def clean_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = closed_stretches(spark, sf_dir).filter("delta_pct >= 12").select("account", "ordinal", "start_us", "end_us", "delta_pct")
    return asof.overlapping(s, runs(spark, sf_dir), ["account"], ("start_us", "end_us"), ("run_start_us", "run_end_us"), 12 * HOUR, "left_anti")


@query(RUNS + "SELECT account, segment, start_us, end_us, value FROM steps s WHERE EXISTS (SELECT 1 FROM runs r WHERE r.account = s.account AND s.start_us <= run_end_us AND run_start_us <= s.end_us)", ["INT-7"])
def steps_touching_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.overlapping(steps_of(spark, sf_dir), runs(spark, sf_dir), ["account"], ("start_us", "end_us"), ("run_start_us", "run_end_us"), 12 * HOUR, "left_semi", closed=True)


@query(RUNS + """, w AS (SELECT DISTINCT account, resets_us - 18000000000 AS w_start_us, resets_us AS w_end_us FROM readings),
p AS (SELECT w.*, CASE WHEN run_start_us = run_end_us THEN 1.0 ELSE (least(run_end_us, w_end_us) - greatest(run_start_us, w_start_us)) / (run_end_us - run_start_us) END AS f, k FROM w JOIN runs r ON r.account = w.account AND w_start_us < run_end_us AND run_start_us < w_end_us)
SELECT account, w_end_us, round(sum(f * (k - 80)) / sum(f * k), 9) AS share FROM p GROUP BY ALL HAVING sum(f * k) > 0""", ["INT-4", "INT-5", "INT-8"])
def overlap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the work in each five-hour window that runs did, each by the part of it inside."""
    w = readings(spark, sf_dir).select("account", (F.col("resets_us") - FIVE_HOURS).alias("w_start_us"), F.col("resets_us").alias("w_end_us")).distinct()
    r = runs(spark, sf_dir).withColumn("part", F.col("k") - 80)
    out = asof.overlap_share(r, w.withColumn("w_id", F.col("w_end_us")), ["account"], ("run_start_us", "run_end_us"), ("w_start_us", "w_end_us"), ["w_id"], "part", "k", 12 * HOUR)
    return out.select("account", F.col("w_id").alias("w_end_us"), F.round("share", 9).alias("share"))


@query(RUNS + "SELECT a.account, a.run AS run, b.run AS other FROM runs a JOIN runs b ON a.account = b.account AND a.k = b.k AND a.run < b.run AND a.run_start_us - 18000000000 < b.run_end_us + 18000000000 AND b.run_start_us - 18000000000 < a.run_end_us + 18000000000", ["FUZ-1"])
def same_run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal account and size whose spans overlap once widened by five hours."""
    r = runs(spark, sf_dir).withColumns({"run_start_us": F.col("run_start_us") - FIVE_HOURS, "run_end_us": F.col("run_end_us") + FIVE_HOURS})
    other = r.select("account", "k", F.col("run").alias("other"), F.col("run_start_us").alias("o_start_us"), F.col("run_end_us").alias("o_end_us"))
    out = asof.overlapping(r, other, ["account", "k"], ("run_start_us", "run_end_us"), ("o_start_us", "o_end_us"), DAY)
    return out.filter("run < other").select("account", "run", "other")


@query("""SELECT a.account, a.upper_us, count(DISTINCT b.account) AS others FROM (SELECT account, prev_ts_us AS lower_us, ts_us AS upper_us FROM pairs WHERE five_hour < prev_five_hour) a
JOIN (SELECT account, prev_ts_us AS lower_us, ts_us AS upper_us FROM pairs WHERE five_hour < prev_five_hour) b ON a.account <> b.account AND a.lower_us - 3600000000 < b.upper_us AND b.lower_us < a.upper_us + 3600000000 GROUP BY ALL""", ["SELF-2"])
def corroborated_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls of the meter that other accounts show within an hour."""
    return asof.others_near(ordered.reset_brackets(readings(spark, sf_dir)), "account", "lower_us", "upper_us", HOUR, HOUR)


@query("SELECT a.account AS account, b.account AS other FROM (SELECT DISTINCT account FROM readings) a JOIN (SELECT DISTINCT account FROM readings) b ON a.account < b.account", ["SELF-3"])
def account_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of accounts, a handful by nature."""
    a = readings(spark, sf_dir).select("account").distinct()
    b = a.withColumnRenamed("account", "other")
    return a.join(b, F.col("account") < F.col("other"))


@query("SELECT account, line, tau FROM (SELECT account, min(ts_us) // 21600000000 AS lo, max(ts_us) // 21600000000 AS hi FROM readings GROUP BY account) s, (VALUES ('five_hour'), ('ratio')) l(line), unnest(range(lo, hi + 1)) t(tau)", ["XJ-1"])
def scan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants six hours apart x lines, for each account's span."""
    ends = readings(spark, sf_dir).groupBy("account").agg(F.floor(F.min("ts_us") / (6 * HOUR)).alias("lo"), F.floor(F.max("ts_us") / (6 * HOUR)).alias("hi"))
    return ends.select("account", F.explode(F.array(F.lit("five_hour"), F.lit("ratio"))).alias("line"), F.sequence("lo", "hi").alias("taus")).select("account", "line", F.explode("taus").alias("tau"))


@query("SELECT DISTINCT model FROM turns WHERE model NOT IN (SELECT model FROM prices)", ["ANTI-3", "ANTI-4"])
def models_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("model").distinct().join(F.broadcast(prices(spark)), "model", "left_anti")


@query(RUNS + """, i AS (SELECT DISTINCT account, run_start_us AS at FROM runs),
m AS (SELECT DISTINCT i.account, list_sort(list_distinct(list(s.k))) AS members FROM i JOIN runs s ON s.account = i.account AND s.run_start_us <= i.at AND i.at < s.run_end_us GROUP BY i.account, i.at)
SELECT account, array_to_string(members, ',') AS members, count(*) OVER () AS n FROM m x
WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.account = x.account AND len(y.members) > len(x.members) AND list_has_all(y.members, x.members))""", ["WIN-12", "SET-3"])
def active_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal sets of run sizes active at one instant."""
    out = windows.active_sets(runs(spark, sf_dir), ["account"], "k", "run_start_us", "run_end_us")
    flat = out.select("account", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))
    return flat.crossJoin(F.broadcast(flat.agg(F.count("*").alias("n"))))


# --- dedupe and merge ------------------------------------------------------------------------------

LINES = ", lines AS (SELECT event_id % 700 AS message_id, user_id % 5 AS file_ord, 'f' || (user_id % 5) AS file, event_id AS line_no, ts_us, event_type AS model, cents AS output, k AS input, event_type = 'error' AS remote FROM e)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("event_id") % 700).alias("message_id"), (F.col("user_id") % 5).alias("file_ord"), F.concat(F.lit("f"), F.col("user_id") % 5).alias("file"), F.col("event_id").alias("line_no"), "ts_us", F.col("event_type").alias("model"), F.col("cents").alias("output"), F.col("k").alias("input"), (F.col("event_type") == "error").alias("remote"))


@query(LINES + """, f AS (SELECT message_id, file, file_ord, arg_min(ts_us, line_no) AS ts_us, arg_min(model, line_no) AS model, max(output) AS output, max(input) AS input, bool_or(remote) AS remote, min(line_no) AS line_no FROM lines GROUP BY ALL)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY file_ord, file) = 1""", ["DED-1", "DED-2", "SRC-7", "PRJ-1"])
def turn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.turns_from_lines(lines(spark, sf_dir), ["output", "input"], flags=["remote"])


@query(LINES + "SELECT file AS source, count(*) AS added FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY file_ord, line_no) = 1) WHERE ts_us < 1706000000000000 GROUP BY ALL", ["DED-3"])
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source adds when earlier sources win, the cut in time coming last."""
    _, added = dedupe.by_source_priority(lines(spark, sf_dir), "message_id", ["file_ord", "line_no"], "file", F.col("ts_us") < 1_706_000_000_000_000)
    return added.withColumnRenamed("file", "source")


SOURCES = ", src AS (SELECT account, ts_us, seq, five_hour, CASE WHEN seq % 3 = 0 THEN NULL ELSE resets_us END AS resets_us, seq % 2 AS priority FROM readings)"


@query(SOURCES + "SELECT account, ts_us // 600000000 AS slot, seq, five_hour FROM src QUALIFY row_number() OVER (PARTITION BY account, ts_us // 60000000 ORDER BY resets_us IS NULL, priority, ts_us, seq) = 1", ["MRG-1", "SET-2", "SRC-24"])
def minute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).withColumn("resets_us", F.when(F.col("seq") % 3 != 0, F.col("resets_us"))).withColumn("priority", F.col("seq") % 2)
    return dedupe.one_a_minute(r).select("account", F.floor(F.col("ts_us") / 600_000_000).alias("slot"), "seq", "five_hour")


@query("SELECT user_id, day, min(event_id) AS event_id FROM (SELECT user_id, ts_us // 86400000000 AS day, event_id FROM e WHERE event_type = 'click') c WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts_us // 86400000000 = c.day) GROUP BY ALL", ["SNK-3", "ANTI-2", "DED-4"])
def append_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh rows whose (user, day) is stored nowhere, once each."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / DAY))
    stored = e.filter("event_type = 'purchase'").select("user_id", "day")
    fresh = e.filter("event_type = 'click'").select("user_id", "day", "event_id")
    return dedupe.new_keys(stored, fresh, ["user_id", "day"], ["event_id"])


DAYS = ", stored AS (SELECT ts_us // 86400000000 AS day, event_type AS model, count(*) AS n FROM e WHERE event_type <> 'view' GROUP BY ALL), fresh AS (SELECT ts_us // 86400000000 AS day, event_type AS model, sum(k)::BIGINT AS n FROM e WHERE event_type = 'view' AND k > 50 GROUP BY ALL)"


def daily_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / DAY))
    stored = e.filter("event_type <> 'view'").groupBy("day", F.col("event_type").alias("model")).agg(F.count("*").alias("n"))
    fresh = e.filter("event_type = 'view' and k > 50").groupBy("day", F.col("event_type").alias("model")).agg(F.sum("k").alias("n"))
    return stored, fresh


@query(DAYS + "SELECT * FROM stored WHERE day < 19730 OR day NOT IN (SELECT day FROM fresh WHERE day >= 19730) UNION ALL SELECT * FROM fresh WHERE day >= 19730", ["SNK-4"])
def day_replace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.replace_days(*daily_counts(spark, sf_dir), 19730)


@query(DAYS + "SELECT * FROM stored WHERE day < (SELECT min(day) FROM fresh) UNION ALL SELECT * FROM fresh", ["SNK-10", "STR-5"])
def keep_older_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_older(*daily_counts(spark, sf_dir))


@query(DAYS + "SELECT * FROM stored UNION ALL SELECT * FROM fresh WHERE model IN ('view')", ["SNK-5"])
def fill_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fill_models(*daily_counts(spark, sf_dir), ["view"])


@query("SELECT user_id AS account, count(*) AS n, 'click' AS kind FROM e WHERE event_type = 'click' AND k > 90 GROUP BY ALL UNION ALL SELECT user_id, count(*), 'error' FROM e WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'click' AND k > 90) GROUP BY ALL", ["MRG-2", "MRG-3", "MRG-4", "SET-1"])
def first_report_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of one report, and of another those the first does not have."""
    e = events(spark, sf_dir)
    report = lambda kind, keep: e.filter((F.col("event_type") == kind) & keep).groupBy(F.col("user_id").alias("account")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return dedupe.first_table_wins(report("click", F.col("k") > 90), report("error", F.lit(True)), ["account"])


# --- requests in conversations ---------------------------------------------------------------------


@query("""SELECT conv_id, turn, last_user, turn - last_user AS lag FROM (
  SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations)
WHERE role = 'assistant' AND last_user IS NOT NULL""", ["SCAN-14", "SRC-10"], views=False)
def request_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the user turn that set it off."""
    from pyspark.sql.window import Window as W

    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    out = c.withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w))
    return out.filter("role = 'assistant' and last_user is not null").select("conv_id", "turn", "last_user", (F.col("turn") - F.col("last_user")).alias("lag"))

