"""Meter scans: pairs, stretches, crossings, steps, windows, segments, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import DAY, HOUR, bundle_value, ratio_interval, utc_day, week_key
from tidewater.operators import asof, ordered, rollup
from tidewater.operators.cut import dealt, written
from tidewater.plans.base import MAX_GAP, events, prices, query, readings, turns

PRICED = {"input": "p_input", "output": "p_output", "cache_read": "p_read", "cache_write": "p_write", "cache_write_1h": "p_write_1h"}


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.reading_pairs(readings(spark, sf_dir), MAX_GAP)


def closed_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.stretches(pair_rows(spark, sf_dir))[0]


def turns_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the stretch whose pairs hold them: one sort of pairs and turns."""
    _, marked = ordered.stretches(pair_rows(spark, sf_dir))
    spans = marked.select("account", "ordinal", F.col("prev_ts_us").alias("from_us"), F.col("ts_us").alias("to_us"), F.col("seq").alias("pair_seq"))
    return asof.contained(turns(spark, sf_dir), spans, ["account"], "ts_us", "from_us", "to_us", ["ordinal"], ["pair_seq"])


def valued(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Turns with their meter value in nano-dollars; null where the model has no price."""
    p = F.broadcast(prices(spark))
    value = bundle_value({c: F.col(c) for c in PRICED}, {c: F.col(v) for c, v in PRICED.items()})
    return rows.join(p, "model", "left").withColumn("nano", (value * F.col("meter_weight")).cast("bigint"))


def stretch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = valued(spark, turns_in_stretches(spark, sf_dir)).groupBy("account", "ordinal").agg(F.sum(F.coalesce("nano", F.lit(0))).alias("nano"), F.count("*").alias("turns"), F.sum(F.when(F.col("nano").isNull(), F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).otherwise(0)).alias("unpriced_tokens"))
    out = closed_stretches(spark, sf_dir).join(sums, ["account", "ordinal"], "left")
    return out.na.fill(0, ["nano", "turns", "unpriced_tokens"])


def stored_stretches(spark: SparkSession, sf_dir: str, models: Sequence[str]) -> DataFrame:
    """Stretches with turns: start, movement, value and each model's input, stored for queries that read them more than once.

    Readings are scanned once: the stored pairs tell both what closed and each turn's stretch. Accounts are
    dealt over a number of tasks that stays, as several sorts of one account follow each other in a task.
    """
    pairs = ordered.reading_pairs(readings(spark, sf_dir, dealt(events(spark, sf_dir), "account")), MAX_GAP)
    marked = written(ordered.pooled(pairs, 10, True, spread=True), "pairs")
    spans = marked.select("account", "ordinal", F.col("prev_ts_us").alias("from_us"), F.col("ts_us").alias("to_us"), F.col("seq").alias("pair_seq"))
    work = turns(spark, sf_dir).select("account", "ts_us", "model", *PRICED)
    held = asof.contained(dealt(work, "account"), dealt(spans, "account"), ["account"], "ts_us", "from_us", "to_us", ["ordinal"], ["pair_seq"])
    inputs = [F.coalesce(F.sum(F.when(F.col("model") == m, F.col("input"))), F.lit(0)).alias(m) for m in models]
    sums = valued(spark, held).groupBy("account", "ordinal").agg(F.sum(F.coalesce("nano", F.lit(0))).alias("nano"), *inputs)
    closed = ordered.closed_movements(marked).select("account", "ordinal", "start_us", "delta_pct")
    return written(closed.join(sums, ["account", "ordinal"]), "stretches")


PAIR_OUT = "SELECT account, seq, ts_us, prev_ts_us, delta, is_reset, broken FROM pairs"


@query(PAIR_OUT, ["SELF-1", "SCAN-16", "PRJ-33"])
def reading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_rows(spark, sf_dir).select("account", "seq", "ts_us", "prev_ts_us", "delta", "is_reset", "broken")


@query("SELECT account, ordinal, start_us, end_us, delta_pct, windows FROM stretches", ["SCAN-2", "PRJ-45"])
def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_stretches(spark, sf_dir)


VALUED = """, valued AS (
  SELECT s.account, s.ordinal, t.input, t.output, t.cache_read, t.cache_write,
         (t.input * p_input + t.output * p_output + t.cache_read * p_read + t.cache_write * p_write + t.cache_write_1h * (p_write_1h - p_write)) * meter_weight AS nano
  FROM stretches s JOIN stretch_turns t USING (account, ordinal) LEFT JOIN prices USING (model)),
stretch_values AS (
  SELECT s.*, coalesce(sum(nano), 0)::BIGINT AS nano, count(v.input) AS turns,
         coalesce(sum(CASE WHEN v.input IS NOT NULL AND nano IS NULL THEN input + output + cache_read + cache_write ELSE 0 END), 0)::BIGINT AS unpriced_tokens
  FROM stretches s LEFT JOIN valued v USING (account, ordinal) GROUP BY ALL)
"""


@query(VALUED + "SELECT account, ordinal, start_us, end_us, delta_pct, windows, nano, turns, unpriced_tokens, nano / 1e11 / delta_pct AS usd_per_pct, nano / 1e11 / (delta_pct + windows) AS lo, CASE WHEN delta_pct > windows THEN nano / 1e11 / (delta_pct - windows) END AS hi FROM stretch_values", ["ASOF-1", "PRJ-8", "PRJ-9", "PRJ-13", "BRD-1", "SCAN-2"])
def stretch_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    usd = F.col("nano") / F.lit(1e11)
    s = stretch_values(spark, sf_dir)
    return s.withColumns({"usd_per_pct": usd / F.col("delta_pct"), "lo": usd / (F.col("delta_pct") + F.col("windows")), "hi": F.when(F.col("delta_pct") > F.col("windows"), usd / (F.col("delta_pct") - F.col("windows")))})


@query(VALUED + "SELECT account, end_us // 86400000000 AS day, sum(nano)::BIGINT AS nano, sum(delta_pct) AS delta_pct, sum(nano) / 1e11 / sum(delta_pct) AS usd_per_pct, count(*) AS n FROM stretch_values GROUP BY ALL", ["SCAN-2", "ASOF-1", "PRJ-8", "AGG-2", "AGG-6"])
def usd_per_pct_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value per percent of meter movement, per account and UTC day of the stretch's end."""
    s = stretch_values(spark, sf_dir).withColumn("day", utc_day(F.col("end_us")))
    out = s.groupBy("account", "day").agg(F.sum("nano").alias("nano"), F.sum("delta_pct").alias("delta_pct"), F.count("*").alias("n"))
    return out.withColumn("usd_per_pct", F.col("nano") / F.lit(1e11) / F.col("delta_pct"))


@query(VALUED + ", p AS (SELECT *, end_us // 86400000000 AS day, coalesce(lag(end_us) OVER (PARTITION BY account ORDER BY start_us, end_us) = start_us, false) AS meets FROM stretch_values) SELECT account, sum(windows)::BIGINT - count(*) FILTER (WHERE meets) AS pieces FROM p GROUP BY account", ["AGG-3"])
def stretch_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.meeting_pieces(closed_stretches(spark, sf_dir), ["account"], "start_us", "end_us", "windows")


ONE = """, one AS (
  SELECT account, n, ts_us, prev_ts_us, delta, NOT is_reset AS counts, CASE WHEN is_reset THEN 0 ELSE 1 END AS ordinal, CASE WHEN is_reset THEN false ELSE delta < 1 END AS open, CASE WHEN is_reset THEN 0 ELSE delta END AS total
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT p.account, p.n, p.ts_us, p.prev_ts_us, p.delta, NOT p.is_reset, f.ordinal + CASE WHEN NOT p.is_reset AND NOT f.open THEN 1 ELSE 0 END,
         CASE WHEN p.is_reset THEN false ELSE CASE WHEN f.open THEN f.total ELSE 0 END + p.delta < 1 END,
         CASE WHEN p.is_reset THEN 0 ELSE CASE WHEN f.open THEN f.total ELSE 0 END + p.delta END
  FROM one f JOIN numbered p ON p.account = f.account AND p.n = f.n + 1),
iv AS (SELECT account, ordinal, min(prev_ts_us) AS start_us, max(ts_us) AS end_us, sum(delta) AS delta_pct FROM one WHERE counts GROUP BY ALL HAVING bool_or(NOT open)),
ivt AS (SELECT o.account, o.ordinal, t.model, sum(t.input + t.output + t.cache_read + t.cache_write) AS tokens FROM one o JOIN turns t ON t.account = o.account AND t.ts_us >= o.prev_ts_us AND t.ts_us < o.ts_us WHERE o.counts GROUP BY ALL),
ivs AS (SELECT account, ordinal, sum(tokens)::BIGINT AS tokens, max(tokens)::BIGINT AS most, arg_max(model, (tokens, model)) AS top FROM ivt GROUP BY ALL),
intervals AS (SELECT iv.*, tokens, CASE WHEN most >= 0.9 * tokens THEN top END AS model FROM iv JOIN ivs USING (account, ordinal) WHERE tokens > 0)
"""


def one_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_rows(spark, sf_dir).withColumn("broken", F.col("is_reset"))
    closed, marked = ordered.stretches(rows, 1, survives=False)
    spans = marked.select("account", "ordinal", F.col("prev_ts_us").alias("from_us"), F.col("ts_us").alias("to_us"), F.col("seq").alias("pair_seq"))
    held = asof.contained(turns(spark, sf_dir), spans, ["account"], "ts_us", "from_us", "to_us", ["ordinal"], ["pair_seq"])
    models = held.groupBy("account", "ordinal", "model").agg(F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens"))
    sums = models.groupBy("account", "ordinal").agg(F.sum("tokens").alias("all_tokens"), F.max("tokens").alias("most"), F.max_by("model", F.struct("tokens", "model")).alias("top"))
    out = closed.join(sums, ["account", "ordinal"]).filter("all_tokens > 0")
    return out.select("account", "ordinal", "start_us", "end_us", "delta_pct", F.col("all_tokens").alias("tokens"), F.when(F.col("most") >= 0.9 * F.col("all_tokens"), F.col("top")).alias("model"))


@query(ONE + "SELECT account, ordinal, start_us, end_us, delta_pct, tokens, model FROM intervals", ["SCAN-1", "ASOF-1b"])
def intervals_1pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_percent(spark, sf_dir)


@query(ONE + """, d AS (SELECT account, end_us // 86400000000 AS day, median(tokens / delta_pct) AS m, count(*) AS n FROM intervals GROUP BY ALL),
c AS (SELECT account, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY account),
j AS (SELECT c.account, c.day, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN m END AS own FROM c LEFT JOIN d USING (account, day))
SELECT account, day, n, last_value(own IGNORE NULLS) OVER (PARTITION BY account ORDER BY day) AS level, own IS NULL AS interpolated FROM j
QUALIFY level IS NOT NULL""", ["AGG-1"])
def locf_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily median rate; thin days carry the last full one."""
    iv = one_percent(spark, sf_dir).withColumn("day", utc_day(F.col("end_us"))).withColumn("rate", F.col("tokens") / F.col("delta_pct"))
    return rollup.daily_with_carry(iv, ["account"], "day", "rate", 5)


@query("SELECT * FROM cross5", ["SCAN-7"])
def crossings_five_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.crossings(readings(spark, sf_dir), "five_hour", "resets_us", MAX_GAP)


@query("SELECT * FROM cross7", ["SCAN-7"])
def crossings_seven_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.crossings(readings(spark, sf_dir), "seven_day", "seven_resets_us", MAX_GAP)


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.unit_steps(ordered.crossings(readings(spark, sf_dir), "seven_day", "seven_resets_us", MAX_GAP))


@query("""SELECT s.account, s.segment, s.start_us, s.end_us, s.value,
  (SELECT count(*) FROM cross5 c WHERE c.account = s.account AND c.upper_us >= s.start_us AND c.upper_us < s.end_us) AS d5,
  (SELECT count(*) FROM turns t WHERE t.account = s.account AND t.ts_us >= s.start_us AND t.ts_us < s.end_us) AS turns,
  (SELECT coalesce(sum(input), 0)::BIGINT FROM turns t WHERE t.account = s.account AND t.ts_us >= s.start_us AND t.ts_us < s.end_us) AS input_tokens
FROM steps s""", ["SCAN-8", "INT-1"])
def seven_day_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-point steps with the crossings and turns in them, from running totals at both ends.

    Totals of one key follow each other in a task, each with a sort of its own, so accounts are dealt over a number of tasks that stays.
    """
    r = dealt(readings(spark, sf_dir), "account")
    steps = ordered.unit_steps(ordered.crossings(r, "seven_day", "seven_resets_us", MAX_GAP))
    five = ordered.crossings(r, "five_hour", "resets_us", MAX_GAP).select("account", F.col("upper_us").alias("at_us"), F.col("value").alias("v"), F.lit(1).alias("n5"))
    work = dealt(turns(spark, sf_dir).select("account", F.col("ts_us").alias("at_us"), F.col("event_id").alias("v"), F.lit(1).alias("n_turns"), F.col("input").alias("n_input")), "account")
    for end in ("start_us", "end_us"):
        steps = asof.running_total_at(steps, five, ["account"], end, "at_us", ["n5"], ["v"], inclusive=False)
        steps = asof.running_total_at(steps, work, ["account"], end, "at_us", ["n_turns", "n_input"], ["v"], inclusive=False)
        steps = steps.withColumnsRenamed({f"total_{c}": f"{c}_{end}" for c in ("n5", "n_turns", "n_input")})
    diff = lambda c: F.col(f"{c}_end_us") - F.col(f"{c}_start_us")
    return steps.select("account", "segment", "start_us", "end_us", "value", diff("n5").alias("d5"), diff("n_turns").alias("turns"), diff("n_input").alias("input_tokens"))


@query("""SELECT account, window_us, value AS from_value, value + 2 AS to_value, upper_us AS from_us, hi_lower AS to_us,
  (SELECT coalesce(sum(input + output + cache_read + cache_write), 0)::BIGINT FROM turns t WHERE t.account = c.account AND t.ts_us >= c.upper_us AND t.ts_us < c.hi_lower) AS tokens
FROM (SELECT *, lead(value, 2) OVER w AS hi_value, lead(lower_us, 2) OVER w AS hi_lower FROM cross5 WINDOW w AS (PARTITION BY account, segment ORDER BY value)) c
WHERE hi_value - value = 2 AND hi_lower >= upper_us""", ["INT-2"])
def tokens_between_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens surely spent between crossings two points apart."""
    crossed = ordered.crossings(readings(spark, sf_dir), "five_hour", "resets_us", MAX_GAP)
    w = W.partitionBy("account", "segment").orderBy("value")
    spans = crossed.withColumns({"to_value": F.lead("value", 2).over(w), "to_us": F.lead("lower_us", 2).over(w)}).filter("to_value - value = 2 and to_us >= upper_us")
    spans = spans.select("account", "window_us", F.col("value").alias("from_value"), "to_value", F.col("upper_us").alias("from_us"), "to_us")
    work = turns(spark, sf_dir).select("account", F.col("ts_us").alias("at_us"), F.col("event_id").alias("v"), (F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tok"))
    for end in ("from_us", "to_us"):
        spans = asof.running_total_at(spans, work, ["account"], end, "at_us", ["tok"], ["v"], inclusive=False).withColumnRenamed("total_tok", f"tok_{end}")
    return spans.withColumn("tokens", F.col("tok_to_us") - F.col("tok_from_us")).drop("tok_from_us", "tok_to_us")


@query("""SELECT s.account, s.from_value, s.at_us, count(*) FILTER (WHERE c.lower_us >= s.lo_upper AND c.upper_us <= s.hi_lower) AS definite,
  (count(*) FILTER (WHERE NOT (c.lower_us >= s.lo_upper AND c.upper_us <= s.hi_lower) AND c.upper_us > s.lo_lower AND c.lower_us < s.lo_upper)
   + count(*) FILTER (WHERE NOT (c.lower_us >= s.lo_upper AND c.upper_us <= s.hi_lower) AND c.upper_us > s.hi_lower AND c.lower_us < s.at_us)) AS ambiguous
FROM (SELECT account, value AS from_value, lower_us AS lo_lower, upper_us AS lo_upper, lead(value, 3) OVER w AS to_value, lead(lower_us, 3) OVER w AS hi_lower, lead(upper_us, 3) OVER w AS at_us
      FROM cross7 WINDOW w AS (PARTITION BY account, segment ORDER BY value)) s
LEFT JOIN cross5 c ON c.account = s.account AND c.upper_us > s.lo_lower AND c.lower_us < s.at_us
WHERE to_value - from_value = 3 AND hi_lower >= lo_upper GROUP BY ALL""", ["INT-3"])
def windows_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-hour crossings surely and possibly inside each run of three seven-day points."""
    r = readings(spark, sf_dir)
    w = W.partitionBy("account", "segment").orderBy("value")
    seven = ordered.crossings(r, "seven_day", "seven_resets_us", MAX_GAP)
    spans = seven.withColumns({"to_value": F.lead("value", 3).over(w), "hi_lower": F.lead("lower_us", 3).over(w), "at_us": F.lead("upper_us", 3).over(w)}).filter("to_value - value = 3 and hi_lower >= upper_us")
    spans = spans.select("account", F.col("value").alias("from_value"), F.col("lower_us").alias("lo_lower"), F.col("upper_us").alias("lo_upper"), "hi_lower", "at_us")
    five = ordered.crossings(r, "five_hour", "resets_us", MAX_GAP).select("account", F.col("lower_us").alias("a_us"), F.col("upper_us").alias("b_us"))
    hits = asof.overlapping(spans, five, ["account"], ("lo_lower", "at_us"), ("a_us", "b_us"), 12 * HOUR)
    inside = (F.col("a_us") >= F.col("lo_upper")) & (F.col("b_us") <= F.col("hi_lower"))
    low = ~inside & (F.col("b_us") > F.col("lo_lower")) & (F.col("a_us") < F.col("lo_upper"))
    high = ~inside & (F.col("b_us") > F.col("hi_lower")) & (F.col("a_us") < F.col("at_us"))
    counts = hits.groupBy("account", "from_value", "at_us").agg(F.count_if(inside).alias("definite"), (F.count_if(low) + F.count_if(high)).alias("ambiguous"))
    return spans.select("account", "from_value", "at_us").join(counts, ["account", "from_value", "at_us"], "left").na.fill(0, ["definite", "ambiguous"])


POINTS = """, wp AS (
  SELECT account, resets_us, five_hour - prev_five_hour AS d5, seven_day - prev_seven_day AS d7, seven_day, seven_resets_us, ts_us, seq,
         NOT (is_reset OR ts_us - prev_ts_us >= 18000000000 OR ts_us - prev_ts_us > 10800000000 OR seven_resets_us <> prev_seven_resets_us OR seven_day < prev_seven_day) AS ok
  FROM pairs),
pieces AS (SELECT *, ok AND NOT coalesce(lag(ok) OVER (PARTITION BY account ORDER BY ts_us, seq), false) AS starts FROM wp),
points AS (
  SELECT account, resets_us AS window_us, sum(d5) AS d5, sum(d7) AS d7, count(*) FILTER (WHERE starts) AS pieces, max(seven_resets_us) AS seven_resets_us
  FROM pieces WHERE ok GROUP BY account, resets_us, seven_resets_us HAVING (sum(d5) > 0 OR sum(d7) > 0) AND max(seven_day) < 100)
"""


@query(POINTS + "SELECT account, window_us, d5, d7, pieces, CASE WHEN d7 > 0 THEN d5 / d7 END AS windows, greatest(0, d5 - 2 * sqrt(pieces::DOUBLE / 6)) / (d7 + 2 * sqrt(pieces::DOUBLE / 6)) AS lo, CASE WHEN d7 > 2 * sqrt(pieces::DOUBLE / 6) THEN (d5 + 2 * sqrt(pieces::DOUBLE / 6)) / (d7 - 2 * sqrt(pieces::DOUBLE / 6)) END AS hi FROM points", ["SCAN-5", "PRJ-38", "PRJ-39", "PRJ-40", "FLT-4"])
def window_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ordered.window_points(readings(spark, sf_dir), MAX_GAP)
    iv = ratio_interval(F.col("d5"), F.col("d7"), F.col("pieces"))
    return p.select("account", "window_us", "d5", "d7", "pieces", F.when(F.col("d7") > 0, F.col("d5") / F.col("d7")).alias("windows"), iv["lo"].alias("lo"), iv["hi"].alias("hi"))


@query(POINTS + """, w AS (SELECT account, (window_us - 1) // 604800000000 AS week, sum(d5) AS d5, sum(d7) AS d7, sum(pieces)::BIGINT AS pieces FROM points GROUP BY ALL HAVING sum(d7) > 0 AND sum(d5) >= 50)
SELECT *, d5 / d7 AS windows, row_number() OVER (PARTITION BY account ORDER BY week DESC) = 1 AS partial FROM w""", ["SCAN-6", "AGG-13", "AGG-12", "PRJ-35"])
def weekly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows a week holds: ratio of the week's sums, weeks that moved at least 50 points."""
    p = ordered.window_points(readings(spark, sf_dir), MAX_GAP).withColumn("week", F.floor((F.col("window_us") - 1) / (7 * DAY)))
    out = rollup.ratio_of_sums(p, ["account", "week"], "d5", "d7", "windows").filter("d7 > 0 and d5 >= 50")
    sums = p.groupBy("account", "week").agg(F.sum("pieces").alias("pieces"))
    newest = F.row_number().over(W.partitionBy("account").orderBy(F.desc("week"))) == 1
    return out.join(sums, ["account", "week"]).withColumn("partial", newest).select("account", "week", "d5", "d7", "pieces", "windows", "partial")


@query("SELECT account, resets_us AS reset_us, min(ts_us) AS first_us, max(ts_us) AS last_us, max(five_hour) AS peak, count(*) AS readings, min(seven_day) AS seven_low, max(seven_day) AS seven_high FROM readings GROUP BY ALL", ["SCAN-17"])
def five_hour_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.five_hour_windows(readings(spark, sf_dir), MAX_GAP).drop("gaps")


@query("SELECT account, segment, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM (SELECT l.account, l.ts_us, sum(coalesce(p.broken, false)::INT) OVER (PARTITION BY l.account ORDER BY l.ts_us, l.seq) AS segment FROM lagged l LEFT JOIN pairs p ON p.account = l.account AND p.seq = l.seq) GROUP BY ALL", ["SCAN-12"])
def meter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordered.meter_segments(readings(spark, sf_dir), MAX_GAP)
    return s.groupBy("account", "segment").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))


@query("SELECT account, prev_ts_us AS lower_us, ts_us AS upper_us FROM pairs WHERE five_hour < prev_five_hour", ["SCAN-16"])
def reset_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.reset_brackets(readings(spark, sf_dir))


@query("""SELECT account, burst, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM (
  SELECT account, ts_us, sum(new) OVER (PARTITION BY account ORDER BY ts_us, event_id) AS burst FROM (
    SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY account ORDER BY ts_us, event_id) >= 2700000000, false)::INT AS new FROM turns)) GROUP BY ALL""", ["SCAN-13"])
def idle_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions split by 45 minutes of silence or more."""
    b = ordered.bursts(turns(spark, sf_dir), ["account"], "ts_us", ["event_id"], 45 * 60_000_000)
    return b.groupBy("account", "burst").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"))


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir)
    usd = F.col("nano") / F.lit(1e11)
    rates = s.select("account", F.lit(0).alias("segment"), "start_us", "end_us", (usd / F.col("delta_pct")).alias("rate"), (usd / (F.col("delta_pct") + F.col("windows"))).alias("lo"), F.when(F.col("delta_pct") > F.col("windows"), usd / (F.col("delta_pct") - F.col("windows"))).alias("hi"), F.lit(0).alias("unpriced"))
    return ordered.judge(rates)


@query(None, ["SCAN-9", "FLT-21"])
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch against the rolling median of accepted ones; brute force in the tests."""
    return verdict_rows(spark, sf_dir)


@query(None, ["SCAN-10", "SELF-2"])
def withheld_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.withheld_runs(verdict_rows(spark, sf_dir))


@query(None, ["SCAN-19"])
def armed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = usd_per_pct_daily(spark, sf_dir).select(F.col("account").alias("series"), (F.col("day") * DAY).alias("ts_us"), F.col("usd_per_pct").alias("value"))
    return ordered.armed_steps(daily)


@query("""SELECT account, max(ts_us) AS last_us, arg_max(five_hour, (ts_us, seq)) AS five_hour, arg_max(seven_day, (ts_us, seq)) AS seven_day, max(ts_us) FILTER (WHERE five_hour > 50) AS last_high_us FROM readings GROUP BY account""", ["SCAN-11", "AGG-41", "TOP-5", "TOP-6"])
def newest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    at = F.struct("ts_us", "seq")
    return r.groupBy("account").agg(F.max("ts_us").alias("last_us"), F.max_by("five_hour", at).alias("five_hour"), F.max_by("seven_day", at).alias("seven_day"), F.max(F.when(F.col("five_hour") > 50, F.col("ts_us"))).alias("last_high_us"))


@query("""SELECT s.account, s.segment, s.start_us, s.end_us, s.value FROM steps s
WHERE NOT EXISTS (SELECT 1 FROM cross5 c WHERE c.account = s.account AND c.upper_us >= s.start_us AND c.upper_us < s.end_us AND c.value > 40)""", ["SCAN-18"])
def quiet_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps during which the five-hour meter crossed no point above 40."""
    high = ordered.crossings(readings(spark, sf_dir), "five_hour", "resets_us", MAX_GAP).filter("value > 40").select("account", F.col("upper_us").alias("at_us"), F.col("value").alias("v"), F.lit(1).alias("n"))
    s = steps_of(spark, sf_dir)
    for end in ("start_us", "end_us"):
        s = asof.running_total_at(s, high, ["account"], end, "at_us", ["n"], ["v"], inclusive=False).withColumnRenamed("total_n", f"n_{end}")
    return s.filter("n_end_us = n_start_us").drop("n_start_us", "n_end_us")


@query("SELECT account, seven_resets_us AS reset_us, ((seven_resets_us + 30000000) // 86400000000) AS week, count(*) AS n, max(seven_day) AS top FROM readings GROUP BY ALL", ["PRJ-35", "PRJ-50", "WIN-10"])
def week_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("account", F.col("seven_resets_us").alias("reset_us"), week_key(F.col("seven_resets_us")).alias("week")).agg(F.count("*").alias("n"), F.max("seven_day").alias("top"))
