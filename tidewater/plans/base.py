"""Registry of named queries, and the meter views that both engines derive from the test tables.

``events`` becomes readings and turns: 40 users are an account; the running sum of an account's cents
within a five-hour and a seven-day bucket is its meter; rows of type ``view`` are readings, the
others are turns whose counters come from the cents and from ``props``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import DAY, FIVE_HOURS, HOUR, WEEK, micros

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}

#: Readings of the test tables are about an hour apart.
MAX_GAP = 3 * HOUR
#: Integer prices a token, in nano-dollars, and a percent weight of the meter: (model, input, output, read, write, write_1h, weight).
PRICES = [("click", 3000, 15000, 300, 3750, 6000, 100), ("error", 1000, 5000, 100, 1250, 2000, 80), ("purchase", 15000, 75000, 1500, 18750, 30000, 100)]

#: Views over ``events`` for DuckDB; a query's own SQL follows after a comma.
VIEWS = """
WITH RECURSIVE e AS (
  SELECT event_id, epoch_us(ts) AS ts_us, user_id, user_id // 40 AS account, event_type, round(value * 100)::BIGINT AS cents, (props->>'$.k')::BIGINT AS k
  FROM events),
sums AS (
  SELECT *, sum(cents) OVER (PARTITION BY account, ts_us // 18000000000 ORDER BY ts_us, event_id) AS s5,
         sum(cents) OVER (PARTITION BY account, ts_us // 604800000000 ORDER BY ts_us, event_id) AS s7
  FROM e),
readings AS (
  SELECT account, ts_us, event_id AS seq, least(100, s5 // 2000)::DOUBLE AS five_hour, least(100, s7 // 40000)::DOUBLE AS seven_day,
         (ts_us // 18000000000 + 1) * 18000000000 AS resets_us, (ts_us // 604800000000 + 1) * 604800000000 AS seven_resets_us
  FROM sums WHERE event_type = 'view'),
turns AS (
  SELECT account, user_id, ts_us, event_id, event_type AS model, cents AS input, k * 10 AS output, cents * 3 AS cache_read, k AS cache_write, k // 2 AS cache_write_1h
  FROM e WHERE event_type <> 'view'),
prices(model, p_input, p_output, p_read, p_write, p_write_1h, meter_weight) AS (VALUES """ + ", ".join(str(p) for p in PRICES) + """),
lagged AS (
  SELECT *, lag(ts_us) OVER w AS prev_ts_us, lag(five_hour) OVER w AS prev_five_hour, lag(seven_day) OVER w AS prev_seven_day,
         lag(resets_us) OVER w AS prev_resets_us, lag(seven_resets_us) OVER w AS prev_seven_resets_us, lag(seq) OVER w AS prev_seq
  FROM readings WINDOW w AS (PARTITION BY account ORDER BY ts_us, seq)),
pairs AS (
  SELECT *, five_hour - prev_five_hour AS delta,
         abs(resets_us - prev_resets_us) > 60000000 OR five_hour < prev_five_hour AS is_reset,
         abs(resets_us - prev_resets_us) > 60000000 OR five_hour < prev_five_hour OR ts_us - prev_ts_us > 10800000000 AS broken
  FROM lagged WHERE prev_ts_us IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts_us, seq) AS n FROM pairs),
folded AS (
  SELECT account, n, ts_us, prev_ts_us, seq, delta, NOT broken AS counts, CASE WHEN broken THEN 0 ELSE 1 END AS ordinal,
         CASE WHEN broken THEN false ELSE delta < 10 END AS open, CASE WHEN broken THEN 0 ELSE delta END AS total, NOT broken AS starts_piece, broken AS piece
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT p.account, p.n, p.ts_us, p.prev_ts_us, p.seq, p.delta, NOT p.broken,
         f.ordinal + CASE WHEN NOT p.broken AND NOT f.open THEN 1 ELSE 0 END,
         CASE WHEN p.broken THEN f.open ELSE CASE WHEN f.open THEN f.total ELSE 0 END + p.delta < 10 END,
         CASE WHEN p.broken THEN f.total ELSE CASE WHEN f.open THEN f.total ELSE 0 END + p.delta END,
         NOT p.broken AND (NOT f.open OR f.piece), p.broken
  FROM folded f JOIN numbered p ON p.account = f.account AND p.n = f.n + 1),
stretches AS (
  SELECT account, ordinal, min(prev_ts_us) AS start_us, max(ts_us) AS end_us, sum(delta) AS delta_pct, count(*) FILTER (WHERE starts_piece) AS windows
  FROM folded WHERE counts GROUP BY ALL HAVING bool_or(NOT open)),
stretch_turns AS (
  SELECT f.account, f.ordinal, t.* EXCLUDE (account) FROM folded f JOIN turns t ON t.account = f.account AND t.ts_us >= f.prev_ts_us AND t.ts_us < f.ts_us WHERE f.counts),
flags5 AS (SELECT *, abs(resets_us - prev_resets_us) > 60000000 OR five_hour < prev_five_hour AS ends, ts_us - prev_ts_us > 10800000000 AS gap FROM lagged WHERE prev_ts_us IS NOT NULL),
seg5 AS (SELECT *, sum(ends::INT) OVER w AS win, sum((ends OR gap)::INT) OVER w AS segment FROM flags5 WINDOW w AS (PARTITION BY account ORDER BY ts_us, seq)),
name5 AS (SELECT *, first(CASE WHEN NOT ends AND NOT gap THEN prev_resets_us END ORDER BY CASE WHEN ends OR gap THEN 1 ELSE 0 END, ts_us, seq) OVER (PARTITION BY account, win) AS window_us FROM seg5),
cross5 AS (SELECT account, prev_ts_us AS lower_us, ts_us AS upper_us, unnest(range(prev_five_hour::BIGINT + 1, five_hour::BIGINT + 1)) AS value, window_us, segment FROM name5 WHERE NOT ends AND NOT gap),
flags7 AS (SELECT *, abs(seven_resets_us - prev_seven_resets_us) > 60000000 OR seven_day < prev_seven_day AS ends, ts_us - prev_ts_us > 10800000000 AS gap FROM lagged WHERE prev_ts_us IS NOT NULL),
seg7 AS (SELECT *, sum(ends::INT) OVER w AS win, sum((ends OR gap)::INT) OVER w AS segment FROM flags7 WINDOW w AS (PARTITION BY account ORDER BY ts_us, seq)),
name7 AS (SELECT *, first(CASE WHEN NOT ends AND NOT gap THEN prev_seven_resets_us END ORDER BY CASE WHEN ends OR gap THEN 1 ELSE 0 END, ts_us, seq) OVER (PARTITION BY account, win) AS window_us FROM seg7),
cross7 AS (SELECT account, prev_ts_us AS lower_us, ts_us AS upper_us, unnest(range(prev_seven_day::BIGINT + 1, seven_day::BIGINT + 1)) AS value, window_us, segment FROM name7 WHERE NOT ends AND NOT gap),
steps AS (
  SELECT * FROM (SELECT account, segment, upper_us AS start_us, lead(upper_us) OVER w AS end_us, lead(value) OVER w AS value, value AS was FROM cross7 WINDOW w AS (PARTITION BY account, segment ORDER BY value, upper_us))
  WHERE value - was = 1)
"""


def query(sql: str | None = None, covers: Iterable[str] = (), views: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is its DuckDB text, after the views unless ``views`` is off."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = tuple(covers)
        if sql:
            ORACLES[f.__name__] = f"{VIEWS} {sql}" if views else sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their account, instant, cents and counter."""
    raw = table(spark, sf_dir, "events")
    return raw.select("event_id", micros(F.col("ts")).alias("ts_us"), "user_id", F.floor(F.col("user_id") / 40).alias("account"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def readings(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The meter's readings; ``of`` is the events where they are dealt already."""
    e = events(spark, sf_dir) if of is None else of
    w = lambda length: W.partitionBy("account", F.floor(F.col("ts_us") / length)).orderBy("ts_us", "event_id")
    level = lambda length, unit: F.least(F.lit(100), F.floor(F.sum("cents").over(w(length)) / unit)).cast("double")
    ends = lambda length: ((F.floor(F.col("ts_us") / length) + 1) * length).cast("bigint")
    e = e.withColumns({"five_hour": level(FIVE_HOURS, 2000), "seven_day": level(WEEK, 40000), "resets_us": ends(FIVE_HOURS), "seven_resets_us": ends(WEEK)})
    return e.filter("event_type = 'view'").select("account", "ts_us", F.col("event_id").alias("seq"), "five_hour", "seven_day", "resets_us", "seven_resets_us")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type <> 'view'")
    return e.select("account", "user_id", "ts_us", "event_id", F.col("event_type").alias("model"), F.col("cents").alias("input"), (F.col("k") * 10).alias("output"), (F.col("cents") * 3).alias("cache_read"), F.col("k").alias("cache_write"), F.floor(F.col("k") / 2).alias("cache_write_1h"))


def prices(spark: SparkSession) -> DataFrame:
    """A literal table of a few rows."""
    return spark.createDataFrame(PRICES, "model string, p_input bigint, p_output bigint, p_read bigint, p_write bigint, p_write_1h bigint, meter_weight bigint")


__all__ = ["COVERS", "DAY", "FIVE_HOURS", "HOUR", "MAX_GAP", "ORACLES", "QUERIES", "WEEK", "events", "prices", "query", "readings", "table", "turns"]
