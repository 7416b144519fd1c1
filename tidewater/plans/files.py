"""Logs, transcripts and histories written from the meter views and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.cut import shared_path
from tidewater.plans.base import events, query, readings, table, turns
from tidewater.sources import claims, readers, sinks


def iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def logged(df: DataFrame, by: str, order: list[str], value: Column, name: str, suffix: str = "") -> str:
    """Write one log a key, its lines in order; returns the folder.

    Rows are sorted by the column of folders first: the writer needs that order, and if it is not there it sorts anew
    and loses the order of lines.
    """
    path = shared_path(df.sparkSession, name)
    rows = df.withColumns({"log": F.concat(F.lit("log-"), F.col(by).cast("string"), F.lit(suffix)), "value": value})
    rows.repartition("log").sortWithinPartitions("log", *order).select("log", "value").write.partitionBy("log").text(path)
    return path


NUMBERED = ", n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts_us, seq) - 1 AS line_no FROM readings)"


@query(NUMBERED + " SELECT account::VARCHAR AS account, line_no, ts_us, five_hour, seven_day, resets_us, seven_resets_us FROM n WHERE seq % 37 <> 0 AND seq % 41 <> 0", ["SRC-1", "SRC-2", "SRC-5", "SRC-6", "SRC-9"])
def meter_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's readings as a JSON log, with lines that are cut short or idle, read back in log order."""
    bucket = lambda v, at: F.struct(v.cast("string").alias("utilization"), iso(F.col(at)).alias("resets_at"))
    line = F.to_json(F.struct(iso(F.col("ts_us")).alias("ts"), F.col("account").cast("string").alias("account"), F.concat(F.lit("id-"), F.col("account").cast("string")).alias("identity"), bucket(F.col("five_hour"), "resets_us").alias("five_hour"), bucket(F.col("seven_day"), "seven_resets_us").alias("seven_day"), (F.col("seq") % 41 == 0).alias("five_hour_idle")))
    path = logged(readings(spark, sf_dir), "account", ["ts_us", "seq"], F.when(F.col("seq") % 37 == 0, F.substring(line, 1, 40)).otherwise(line), "meter-logs")
    return readers.read_log(spark, "meter", path).select("account", "line_no", "ts_us", "five_hour", "seven_day", "resets_us", "seven_resets_us")


@query(NUMBERED + " SELECT CASE WHEN account % 2 = 0 THEN 'gate' ELSE 'ceiling' END AS source, line_no, ts_us // 1000000 * 1000000 AS ts_us, five_hour, seven_day FROM n WHERE seq % 29 <> 0", ["SRC-3", "SRC-4"])
def text_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as lines of a gate's and a ceiling's text log, among lines of other kinds."""
    at, five, seven = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("five_hour").cast("int").cast("string"), F.col("seven_day").cast("int").cast("string")
    gate = F.concat(at, F.when(F.col("seq") % 2 == 0, " ok five_hour=").otherwise(" HARD CEILING (x-1) five_hour="), five, F.lit("% seven_day="), seven, F.lit("%"))
    ceiling = F.concat(at, F.lit(" 5-hour "), five, F.lit("% / 7-day "), seven, F.lit("%"))
    other, out = F.concat(at, F.lit(" started")), []
    for fmt, line, half in (("gate", gate, 0), ("ceiling", ceiling, 1)):
        r = readings(spark, sf_dir).filter(F.col("account") % 2 == half)
        path = logged(r, "account", ["ts_us", "seq"], F.when(F.col("seq") % 29 == 0, other).otherwise(line), f"{fmt}-logs")
        out.append(readers.read_log(spark, fmt, path).select("source", "line_no", "ts_us", "five_hour", "seven_day"))
    return out[0].unionByName(out[1])


@query(" SELECT 'm' || event_id AS message_id, ts_us // 1000 * 1000 AS ts_us, model, input, output, cache_read, cache_write, cache_write_1h FROM turns WHERE event_id % 31 <> 0", ["SRC-8", "DED-2"])
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as transcript lines of each account, a message told twice with growing counters, read back as one row a message."""
    t = turns(spark, sf_dir).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    part = lambda c: F.when(F.col("half") == 0, F.floor(F.col(c) / 2)).otherwise(F.col(c))
    usage = F.struct(part("input").alias("input_tokens"), part("output").alias("output_tokens"), part("cache_read").alias("cache_read_input_tokens"), part("cache_write").alias("cache_creation_input_tokens"), F.struct((part("cache_write") - part("cache_write_1h")).alias("ephemeral_5m_input_tokens"), part("cache_write_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    at = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.when(F.col("event_id") % 31 == 0, "user").otherwise("assistant")
    line = F.to_json(F.struct(kind.alias("type"), at.alias("timestamp"), F.struct(F.concat(F.lit("m"), "event_id").alias("id"), "model", usage.alias("usage")).alias("message")))
    path = logged(t, "account", ["ts_us", "event_id", "half"], line, "transcripts", ".jsonl")
    found = readers.turns(readers.transcripts(spark, _as_jsonl(spark, path)))
    return found.select("message_id", "ts_us", "model", "input", "output", "cache_read", "cache_write", "cache_write_1h")


def _as_jsonl(spark: SparkSession, path: str) -> str:
    """Spark names its text files *.txt; transcripts are *.jsonl."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(hadoop.Path(f"{path}/*/*.txt")):
        old = found.getPath()
        fs.rename(old, hadoop.Path(old.toString()[: -len(".txt")] + ".jsonl"))
    return path


@query(" SELECT account, day, num, den FROM (SELECT account, ts_us // 86400000000 AS day, sum(cents)::BIGINT AS num, sum(k)::BIGINT AS den FROM e GROUP BY ALL) WHERE day % 5 <> 0", ["SRC-13", "SRC-14", "SRC-27"])
def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stored as a history of JSON lines; lines that do not parse are skipped."""
    from tidewater.plans.relational import daily

    d = daily(spark, sf_dir)
    line = F.when(F.col("day") % 5 == 0, F.lit("{\"account\": 1, ")).otherwise(F.to_json(F.struct("account", "day", "num", "den")))
    return readers.history(spark, logged(d, "account", ["day"], line, "history"), "account bigint, day bigint, num bigint, den bigint")


@query(NUMBERED + """ SELECT line_no AS seq, CASE WHEN seq % 23 <> 0 AND seq % 19 <> 0 THEN ts_us END AS ts_us, CASE WHEN seq % 23 <> 0 AND seq % 19 <> 0 THEN five_hour END AS five_hour, CASE WHEN seq % 23 <> 0 AND seq % 19 <> 0 THEN seven_day END AS seven_day, CASE WHEN seq % 23 <> 0 AND seq % 19 <> 0 THEN resets_us END AS resets_us FROM n""", ["SRC-11", "SRC-12"])
def usage_row_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as usage rows; a line cut short, or without a reset, has null figures and stays as a break."""
    reset = F.when(F.col("seq") % 19 != 0, iso(F.col("resets_us")))
    line = F.to_json(F.struct(iso(F.col("ts_us")).alias("ts"), "five_hour", reset.alias("five_resets_at"), "seven_day", iso(F.col("seven_resets_us")).alias("seven_resets_at")))
    path = logged(readings(spark, sf_dir), "account", ["ts_us", "seq"], F.when(F.col("seq") % 23 == 0, F.substring(line, 1, 30)).otherwise(line), "usage-rows")
    return readers.usage_rows(spark, path).select("seq", "ts_us", "five_hour", "seven_day", "resets_us")


@query(" SELECT ts_us // 1000000 * 1000000 AS at_us, 'run-' || user_id || CASE WHEN event_id % 2 = 0 THEN '-part' ELSE '' END AS name, 'session_' || event_id AS session FROM e WHERE event_type = 'purchase' AND event_id % 7 <> 0", ["SRC-17"])
def launch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as a launch log whose columns vary, some without a session."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    at = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws("\t", at, F.concat(F.lit("run-"), "user_id"), F.when(F.col("event_id") % 2 == 0, "part"), F.sha1(F.col("event_id").cast("string").cast("binary")), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("session_"), "event_id")))
    return readers.launches(spark, logged(e, "account", ["ts_us", "event_id"], line, "launches"))


@query(""", l AS (SELECT account, event_id, event_type, row_number() OVER (PARTITION BY account ORDER BY ts_us, event_id) AS n FROM e),
r AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY account ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM l)
SELECT run, count(*) AS lines, arg_min(event_type || ' ' || event_id, n) AS first, arg_max(event_type || ' ' || event_id, n) AS last FROM r GROUP BY account, run HAVING arg_max(event_type, n) = 'purchase'""", ["SRC-26"])
def log_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operations log; a purchase ends a run."""
    e = events(spark, sf_dir)
    path = logged(e, "account", ["ts_us", "event_id"], F.concat_ws(" ", "event_type", "event_id"), "operations")
    return readers.run_logs(spark, path, "^purchase ").select("run", "lines", "first", "last")


@query(" SELECT account, ts_us // 1000000 * 1000000 AS start_us, ts_us // 1000000 * 1000000 + k * 1000000 AS end_us, event_type AS kind FROM e WHERE event_type = 'error' AND event_id % 3 <> 0", ["SRC-16"])
def excluded_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as excluded spans, some without an end."""
    e = events(spark, sf_dir).filter("event_type = 'error'")
    at = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when(F.col("event_id") % 3 != 0, at(F.col("ts_us") + F.col("k") * 1_000_000))
    line = F.to_json(F.struct(F.col("account").cast("string").alias("account"), at(F.col("ts_us")).alias("start"), end.alias("end"), F.col("event_type").alias("kind")))
    return readers.excluded_runs(spark, logged(e, "account", ["ts_us", "event_id"], line, "spans")).select(F.col("account").cast("bigint").alias("account"), "start_us", "end_us", "kind")


@query(" SELECT seq, five_hour / 100 * 100 AS five_hour, seven_day / 100 * 100 AS seven_day, CASE WHEN seq % 5 <> 0 THEN resets_us END AS resets_us, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS problems FROM readings", ["SRC-21"])
def header_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as response headers in mixed case, some without a reset."""
    r = readings(spark, sf_dir)
    second = lambda c: F.floor(F.col(c) / 1_000_000).cast("string")
    entries = [("5h-Utilization", (F.col("five_hour") / 100).cast("string")), ("7d-utilization", (F.col("seven_day") / 100).cast("string")), ("5h-reset", second("resets_us")), ("7d-Reset", second("seven_resets_us"))]
    pairs = [x for k, v in entries for x in (F.lit(f"X-Limit-{k}"), v)]
    headers = F.map_filter(F.create_map(*pairs), lambda k, _: (F.col("seq") % 5 != 0) | (k != "X-Limit-5h-reset"))
    out = readers.header_readings(r.select("seq", headers.alias("headers")), "x-limit-")
    return out.select("seq", "five_hour", "seven_day", "resets_us", F.size("problems").alias("problems"))


@query(" SELECT account, seq, ts_us, five_hour, seven_day, resets_us FROM readings", ["SNK-11", "SNK-12"])
def reading_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's readings frozen as one JSON document of columns, stored, and read back."""
    columns = ["seq", "ts_us", "five_hour", "seven_day", "resets_us"]
    r = readings(spark, sf_dir)
    path = shared_path(spark, "snapshot")
    sinks.snapshot(r, "account", ["ts_us", "seq"], columns).write.json(path)
    return readers.from_snapshot(spark, path, "account bigint", ["seq bigint", "ts_us bigint", "five_hour double", "seven_day double", "resets_us bigint"])


@query(" SELECT account, event_id, ts_us, model, input, event_id = (SELECT min(event_id) FROM turns) AS outlier FROM turns", ["SNK-2", "SNK-8", "SNK-9"])
def extracted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named columns of turns in a folder an account, appended in two halves and read back, with one row marked."""
    t, path = turns(spark, sf_dir), shared_path(spark, "extract")
    for half in (0, 1):
        sinks.extract(t.filter(F.col("event_id") % 2 == half), path, ["event_id", "ts_us", "model", "input"], "account")
    back = spark.read.schema("event_id bigint, ts_us bigint, model string, input bigint, account bigint").json(path)
    return sinks.mark(back, "event_id", back.agg(F.min("event_id")).first()[0])


@query(" SELECT CASE WHEN account % 2 = 0 THEN 'even' ELSE 'odd' END AS group_name, 's' || user_id AS session, ts_us // 1000 * 1000 AS ts_us FROM e WHERE event_type = 'error' AND event_id % 13 <> 0", ["STR-15"])
def claim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as prompts in two logins' histories, read into the store of claims; a second look reads no file."""
    e = events(spark, sf_dir).filter("event_type = 'error'")
    root, cache = shared_path(spark, "logins"), shared_path(spark, "claims")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("s"), "user_id")).alias("sessionId"), F.floor(F.col("ts_us") / 1000).alias("timestamp")))
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {}
    for name, half in (("even", 0), ("odd", 1)):
        own = e.filter(F.col("account") % 2 == half)
        if own.isEmpty():
            continue
        folders[name] = f"{root}/{name}"
        for i, found in enumerate(fs.globStatus(hadoop.Path(logged(own, "account", ["ts_us", "event_id"], line, "prompts") + "/*/*.txt"))):
            fs.mkdirs(hadoop.Path(f"{folders[name]}/{i}"))
            fs.rename(found.getPath(), hadoop.Path(f"{folders[name]}/{i}/history.jsonl"))
    claims.refresh(spark, folders, cache)
    if claims.refresh(spark, folders, cache):
        raise AssertionError("an unchanged file was read again")
    return claims.claims(spark, cache).select(F.col("group").alias("group_name"), "session", "ts_us")


#: Head cells of a price page, the class each names, and the multiple of a part's price under it.
PRICE_HEADS = [("Base input", "input", 1), ("5m cache writes", "cache_write", 2), ("1h cache-writes", "cache_write_1h", 3), ("Cache hits", "cache_read", 4), ("Output tokens", "output", 5)]


@query("SELECT p_partkey // 10 AS id, 'part-' || p_partkey AS model, c.class, round(p_retailprice * c.k, 2) AS usd FROM part, (VALUES " + ", ".join(f"('{c}', {k})" for _, c, k in PRICE_HEADS) + ") c(class, k) WHERE p_partkey // 10 IN (SELECT p_partkey // 10 FROM part GROUP BY 1 HAVING count(*) >= 2)", ["SRC-18"], views=False)
def price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts a page as models of its price table, beside a smaller table of the same columns and one of others; a page of one model has no main table."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    head = F.concat(F.lit("<tr>"), *[cell("th", F.lit(h)) for h in ("Model", *[h for h, _, _ in PRICE_HEADS])], F.lit("</tr>"))
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("id"), "p_partkey", "p_retailprice", "p_name")
    prices = [cell("td", F.concat(F.lit("$"), F.format_number(F.col("p_retailprice") * k, 2), F.lit(" / MTok"))) for _, _, k in PRICE_HEADS]
    name = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit("<span>"), F.coalesce("p_name", F.lit("")), F.lit("</span>"))
    row = F.concat(F.lit("<tr>"), cell("td", name), *prices, F.lit("</tr>"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]), "")
    small = F.concat(F.lit("<table>"), head, F.min_by(row, "p_partkey"), F.lit("</table>"))
    pages = p.groupBy("id").agg(F.concat(F.lit("<p>Prices</p>"), small, F.lit("<table>"), head, rows, F.lit("</table><table><tr><td>Other</td></tr></table>")).alias("html"))
    model = lambda c: F.when(c.rlike("^Part [0-9]+$"), F.lower(F.replace(c, F.lit(" "), F.lit("-"))))
    return readers.price_table(pages, "id", "html", model)
