"""Scalar valuation, selection rules and projections over the meter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import values as V
from tidewater.plans.base import events, prices, query, table, turns
from tidewater.plans.metering import PRICED, VALUED, stretch_values, turns_in_stretches, valued

CLASSES = ("input", "output", "cache_read", "cache_write")


@query("""SELECT event_id, model, (input * p_input + output * p_output + cache_read * p_read + cache_write * p_write + cache_write_1h * (p_write_1h - p_write)) * meter_weight AS nano,
  input * p_input + output * p_output + cache_read * p_read + cache_write * p_write AS list_nano, input + cache_write + cache_read AS input_side FROM turns LEFT JOIN prices USING (model)""", ["PRJ-7", "PRJ-9", "PRJ-10", "PRJ-11", "PRJ-21"])
def turn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter value and list value of every turn; null without a price."""
    t = valued(spark, turns(spark, sf_dir))
    listed = V.bundle_value({c: F.col(c) for c in CLASSES}, {c: F.col(PRICED[c]) for c in CLASSES})
    return t.select("event_id", "model", "nano", listed.alias("list_nano"), V.input_side(F.col("input"), F.col("cache_write"), F.col("cache_read"), F.lit(1)).alias("input_side"))


@query("""SELECT account, sum(input)::DOUBLE / sum(input + output + cache_read + cache_write) AS input, sum(output)::DOUBLE / sum(input + output + cache_read + cache_write) AS output,
  sum(cache_read)::DOUBLE / sum(input + output + cache_read + cache_write) AS cache_read, sum(cache_write)::DOUBLE / sum(input + output + cache_read + cache_write) AS cache_write FROM turns GROUP BY account""", ["AGG-5", "PRJ-28", "PRJ-30"])
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = turns(spark, sf_dir).groupBy("account").agg(*[F.sum(c).alias(c) for c in CLASSES])
    total = sum((F.col(c) for c in CLASSES), F.lit(0))
    return sums.select("account", *[(F.col(c).cast("double") / total).alias(c) for c in CLASSES])


@query("""SELECT model, sum(input * p_input + output * p_output + cache_read * p_read + cache_write * p_write)::DOUBLE / sum(input + output + cache_read + cache_write) AS nano_per_token,
  (p_input * 5 + p_output * 2 + p_read * 2 + p_write * 1)::DOUBLE / 10 AS reference_mix FROM turns JOIN prices USING (model) GROUP BY model, p_input, p_output, p_read, p_write""", ["PRJ-14", "PRJ-15", "PRJ-52"])
def blended_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of an average token by model, of its own mix and of a fixed one."""
    sums = turns(spark, sf_dir).groupBy("model").agg(*[F.sum(c).alias(c) for c in CLASSES]).join(F.broadcast(prices(spark)), "model")
    price = {c: F.col(PRICED[c]) for c in CLASSES}
    mix = V.blended_price({"input": F.lit(5), "output": F.lit(2), "cache_read": F.lit(2), "cache_write": F.lit(1)}, price)
    whole = sum((F.col(c) for c in CLASSES), F.lit(0))
    return sums.select("model", (V.bundle_value({c: F.col(c) for c in CLASSES}, price).cast("double") / whole).alias("nano_per_token"), (mix.cast("double") / 10).alias("reference_mix"))


@query(VALUED + """SELECT s.account, s.ordinal, CASE WHEN count(v.input) = 0 OR bool_or(v.input IS NOT NULL AND v.nano IS NULL) THEN NULL ELSE sum(v.nano)::BIGINT END AS nano, count(v.input) AS turns,
  count(*) FILTER (WHERE v.input IS NOT NULL AND v.nano IS NULL) AS unpriced FROM stretches s LEFT JOIN valued v USING (account, ordinal) GROUP BY ALL""", ["PRJ-22", "PRJ-23", "PRJ-25", "FLT-13", "FLT-25"])
def stretch_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch's value, null as soon as one of its turns has no price."""
    from tidewater.plans.metering import closed_stretches

    t = valued(spark, turns_in_stretches(spark, sf_dir)).groupBy("account", "ordinal").agg(F.sum("nano").alias("nano"), F.count("*").alias("turns"), F.count_if(F.col("nano").isNull()).alias("unpriced"))
    out = closed_stretches(spark, sf_dir).select("account", "ordinal").join(t, ["account", "ordinal"], "left").na.fill(0, ["turns", "unpriced"])
    return out.withColumn("nano", F.when((F.col("turns") > 0) & (F.col("unpriced") == 0), F.col("nano")))


@query(VALUED + "SELECT account, ordinal, CASE WHEN turns = 0 THEN 'no-tokens' WHEN unpriced_tokens > 0 THEN 'unpriced' WHEN nano / 1e11 / delta_pct < 0.002 THEN 'collection_gap' ELSE 'publishable' END AS rule FROM stretch_values", ["FLT-5", "FLT-13", "AGG-8"])
def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stretch_values(spark, sf_dir)
    rule = F.when(F.col("turns") == 0, "no-tokens").when(F.col("unpriced_tokens") > 0, "unpriced").when(F.col("nano") / F.lit(1e11) / F.col("delta_pct") < 0.002, "collection_gap").otherwise("publishable")
    return s.select("account", "ordinal", rule.alias("rule"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'STANDARD ANODIZED') THEN 'anodized' WHEN contains(p_type, 'STANDARD') THEN 'standard' WHEN contains(p_type, 'ECONOMY') THEN 'economy' WHEN contains(p_type, 'BRASS') THEN 'brass' ELSE NULL END AS family FROM part""", ["PRJ-16", "PRJ-19", "FLT-24"], views=False)
def longest_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of the longest needle that a name contains."""
    needles = {"STANDARD ANODIZED": "anodized", "STANDARD": "standard", "ECONOMY": "economy", "BRASS": "brass"}
    return table(spark, sf_dir, "part").select("p_partkey", V.family(F.col("p_type"), needles).alias("family"))


MODEL_IDS = "CASE event_id % 6 WHEN 0 THEN 'alpha-5-1[1m]' WHEN 1 THEN 'alpha-5-1-20260101' WHEN 2 THEN 'beta-4' WHEN 3 THEN 'old-beta' WHEN 4 THEN 'gamma-9' ELSE NULL END"


@query(f"""SELECT event_id, CASE WHEN c IN ('alpha-5-1', 'beta-4') THEN c END AS known, coalesce(c, 'unknown') AS raw, nullif(regexp_extract(c, '^([a-z]+(-[0-9]+)+)$', 1), '') AS model_key
FROM (SELECT event_id, CASE WHEN b = 'old-beta' THEN 'beta-4' ELSE b END AS c FROM (SELECT event_id, regexp_replace(regexp_replace(m, '\\[1m\\]$', ''), '-[0-9]{{8}}$', '') AS b FROM (SELECT event_id, {MODEL_IDS} AS m FROM events)))""", ["PRJ-3", "PRJ-4", "PRJ-5", "PRJ-17", "PRJ-18"], views=False)
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(MODEL_IDS).alias("m"))
    aliases = {"old-beta": "beta-4"}
    raw = V.raw_model(F.col("m"), aliases)
    key = F.nullif(F.regexp_extract(F.when(F.col("m").isNotNull(), raw), r"^([a-z]+(-[0-9]+)+)$", 1), F.lit(""))
    return e.select("event_id", V.normalize_model(F.col("m"), ["alpha-5-1", "beta-4"], aliases).alias("known"), raw.alias("raw"), key.alias("model_key"))


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '/subagents/') THEN regexp_extract(p, '([^/]+)/subagents/', 1) ELSE regexp_extract(p, '([^/]+?)([.][^./]*)?$', 1) END AS session
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/home/s' || page_id || '/subagents/a.jsonl' ELSE '/home/x/s' || page_id || '.jsonl' END AS p FROM pages)""", ["PRJ-6"], views=False)
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("CASE WHEN page_id % 3 = 0 THEN concat('/home/s', page_id, '/subagents/a.jsonl') ELSE concat('/home/x/s', page_id, '.jsonl') END").alias("p"))
    return p.select("page_id", V.session_of_path(F.col("p")).alias("session"))


@query("""SELECT event_id, (ts_us + 30000000) // 86400000000 AS week_key, epoch(date_trunc('week', make_timestamp(ts_us)) + INTERVAL 6 DAY)::BIGINT // 86400 AS iso_week_end, ts_us // 86400000000 AS day,
  strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') AS stamp, ts_us - 18000000000 AS window_start FROM e""", ["PRJ-32", "PRJ-34", "PRJ-35", "PRJ-36", "PRJ-37", "PRJ-43", "PRJ-50"])
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts_us")
    return events(spark, sf_dir).select("event_id", V.week_key(t).alias("week_key"), V.iso_week_ending(t).alias("iso_week_end"), V.utc_day(t).alias("day"), V.iso_z(t).alias("stamp"), V.window_start(t).alias("window_start"))


@query("""SELECT event_id, floor(ln(value) / ln(1.02))::BIGINT AS bin, floor(value + 0.5)::BIGINT AS rounded, CASE WHEN value < 10 THEN 'measured' WHEN value < 50 THEN 'provisional' ELSE 'measuring' END AS state FROM events WHERE value > 0""", ["PRJ-44", "PRJ-47", "PRJ-53", "PRJ-54"], views=False)
def bins_and_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").filter("value > 0")
    state = F.when(v < 10, "measured").when(v < 50, "provisional").otherwise("measuring")
    return e.select("event_id", V.log_bin(v).alias("bin"), V.half_up(v).cast("bigint").alias("rounded"), state.alias("state"))


@query("""SELECT c_custkey, c_nationkey + 1 AS df, round(CASE WHEN c_nationkey = 0 THEN 12.706204736432095 WHEN c_nationkey = 1 THEN 4.302652729911275 ELSE z + g1/d + g2/(d*d) + g3/(d*d*d) + g4/(d*d*d*d) END, 9) AS t
FROM (SELECT c_custkey, c_nationkey, (c_nationkey + 1)::DOUBLE AS d, 1.959963984540054::DOUBLE AS z,
  (pow(1.959963984540054, 3) + 1.959963984540054::DOUBLE) / 4 AS g1, (5*pow(1.959963984540054, 5) + 16*pow(1.959963984540054, 3) + 3*1.959963984540054::DOUBLE) / 96 AS g2,
  (3*pow(1.959963984540054, 7) + 19*pow(1.959963984540054, 5) + 17*pow(1.959963984540054, 3) - 15*1.959963984540054::DOUBLE) / 384 AS g3,
  (79*pow(1.959963984540054, 9) + 776*pow(1.959963984540054, 7) + 1482*pow(1.959963984540054, 5) - 1920*pow(1.959963984540054, 3) - 945*1.959963984540054::DOUBLE) / 92160 AS g4 FROM customer)""", ["PRJ-46"], views=False)
def t_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("df", F.col("c_nationkey") + 1)
    return c.select("c_custkey", "df", F.round(V.t975(F.col("df").cast("double")), 9).alias("t"))


@query("""SELECT event_id, CASE WHEN k IS NULL THEN 'missing' WHEN k % 7 = 0 THEN 'zero-week' ELSE 'ok' END AS problem, CASE WHEN k BETWEEN 10 AND 99 THEN k::DOUBLE END AS number
FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)""", ["SRC-22", "SRC-23", "PRJ-31"], views=False)
def json_variant_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a JSON body read as a variant, telling a null from a missing key."""
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    k = F.try_variant_get("v", "$.k", "bigint")
    number = V.finite_number(F.get_json_object("props", "$.k"))
    return e.select("event_id", F.when(k.isNull(), "missing").when(k % 7 == 0, "zero-week").otherwise("ok").alias("problem"), F.when(number.between(10, 99), number).alias("number"))


@query("""SELECT event_id, cents + CASE WHEN k % 4 = 0 THEN k * 2 ELSE k END AS total, CASE WHEN k % 4 = 0 THEN k + k ELSE k END AS cache_write FROM e""", ["PRJ-1", "PRJ-2"])
def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate counter, or its two parts where the aggregate is 0 or missing."""
    e = events(spark, sf_dir)
    k = F.col("k")
    write = V.cache_write_total(F.when(k % 4 != 0, k).when(k % 8 == 0, F.lit(0)), k, k)
    return e.select("event_id", (F.col("cents") + write).alias("total"), write.alias("cache_write"))


@query("""SELECT account, model, total FROM (SELECT account, model, sum(input + output)::BIGINT AS total FROM turns WHERE input % 5 <> 0 GROUP BY ALL) WHERE total > 0""", ["PRJ-28", "PRJ-29", "PRJ-41", "PRJ-27"])
def bundle_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token bundles as maps of models, empty ones dropped, back to rows."""
    t = turns(spark, sf_dir).groupBy("account", "model").agg(F.sum(F.when(F.col("input") % 5 != 0, F.col("input") + F.col("output")).otherwise(0)).alias("n"))
    maps = t.groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("model", F.create_map(F.lit("total"), F.col("n"))))).alias("bundles"))
    return maps.withColumn("bundles", V.bundles_with_work(F.col("bundles"))).select("account", F.explode("bundles").alias("model", "classes")).select("account", "model", F.col("classes")["total"].alias("total"))


@query("SELECT event_id, user_id, value FROM events WHERE value >= 3 AND value < 150 AND event_type NOT IN ('error') AND value <> 50", ["FLT-1", "FLT-2", "FLT-3", "FLT-22"], views=False)
def kept_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter((F.col("value") >= 3) & (F.col("value") < 150) & (F.col("event_type") != "error") & (F.col("value") != 50)).select("event_id", "user_id", "value")


@query(VALUED + "SELECT account, ordinal, (start_us < 1705276800000000 AND end_us > 1705276800000000) AS spans_cut, end_us <= 1705276800000000 AS known, (start_us >= 1705276800000000)::INT + (start_us >= 1705881600000000)::INT AS regime, (end_us > 1705276800000000)::INT + (end_us > 1705881600000000)::INT AS span FROM stretch_values", ["FLT-10", "FLT-11", "FLT-14", "FLT-17", "FLT-18", "FLT-19", "WIN-10", "WIN-11"])
def regimes_of_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of two instants each stretch lies on, by its start (at counts) and its end (at does not)."""
    from tidewater.operators.rollup import by_regime
    from tidewater.plans.metering import closed_stretches

    cuts = [1705276800000000, 1705881600000000]
    s = by_regime(closed_stretches(spark, sf_dir), cuts, "start_us")
    s = by_regime(s.withColumnRenamed("regime", "_r"), cuts, "end_us", strict=True).withColumnsRenamed({"regime": "span", "_r": "regime"})
    cut = F.lit(cuts[0])
    return s.select("account", "ordinal", ((F.col("start_us") < cut) & (F.col("end_us") > cut)).alias("spans_cut"), (F.col("end_us") <= cut).alias("known"), "regime", "span")
