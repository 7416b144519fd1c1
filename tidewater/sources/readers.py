"""Readers: meter logs, text logs, transcripts, launches, price pages, histories and archives as DataFrames.

Line order is data here (the first line of a message names it). A file is cut into blocks that tasks read
apart; a line's number is its place in its block plus the lines of the blocks before it.
Every reader takes any path or list of paths that Spark can open.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Callable, Iterator, Sequence
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import cache_write_total, finite_number, parse_instant

Paths = str | Sequence[str]

# Fixed formats: log lines and JSON shapes that the readers must match.
GATE_LOG = r"^(\S+) (?:ok|warn|HARD CEILING \([\w-]+\)) five_hour=(\d+)% seven_day=(\d+)%"
CEILING_LOG = r"^(\S+) 5-hour (\d+)% / 7-day (\d+)%"
BUCKET = "struct<utilization:string,resets_at:string>"
METER = f"ts string, account string, identity string, five_hour {BUCKET}, seven_day {BUCKET}, five_hour_idle boolean, weekly_only boolean, error string"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,speed:string>"
TRANSCRIPT = f"type string, timestamp string, isSidechain boolean, entrypoint string, remoteSourced boolean, sessionId string, file string, message struct<id:string,model:string,usage:{USAGE}>"


def numbered_lines(spark: SparkSession, paths: Paths, **options: object) -> DataFrame:
    """(file, line_no, value) of every line of text files, gzip included, whichever tasks read a file's blocks.

    Within a block a task meets lines in order; a count of each block's lines, one row a block, tells how
    many come before it. The files must not change while they are read.
    """
    text = spark.read.text(paths, lineSep="\n", recursiveFileLookup=True, **{k: v for k, v in options.items() if v is not None})
    at = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("value"))
    blocks = at.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return at.join(blocks, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")


def lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, line_no, value) of text files in file order; empty lines count but are dropped."""
    return numbered_lines(spark, paths).filter("value <> ''")


def json_lines(spark: SparkSession, paths: Paths, schema: str, on_error: str = "drop") -> DataFrame:
    """JSON lines with file and ordinal. ``on_error``: drop the line, keep it as a null ``row`` (which breaks pairs), or fail."""
    rows = lines(spark, paths).withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    whole = F.get_json_object("value", "$").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    rows = rows.withColumn("row", F.when(whole, F.col("row")))
    if on_error == "drop":
        rows = rows.filter("row is not null")
    elif on_error == "fail":
        rows = rows.withColumn("row", F.when(F.col("row").isNull() & (F.col("value") != ""), F.raise_error(F.concat(F.lit("not a JSON object: "), "file", F.lit(":"), F.col("line_no") + 1))).otherwise(F.col("row")))
    return rows.drop("value")


# --- meter readings ---------------------------------------------------------------------------------


def _reading(source: str, five: Column, seven: Column, reset: Column, seven_reset: Column, ts: Column) -> list[Column]:
    return [parse_instant(ts).alias("ts_us"), five.cast("double").alias("five_hour"), seven.cast("double").alias("seven_day"), parse_instant(reset).alias("resets_us"), parse_instant(seven_reset).alias("seven_resets_us"), F.lit(source).alias("source")]


def meter_json(spark: SparkSession, paths: Paths, source: str = "shared-meter", weekly: bool = False) -> DataFrame:
    """Readings of a JSON meter log. A row without a five-hour figure (or an idle one) counts only for ``weekly`` readers, with a seven-day figure."""
    rows = json_lines(spark, paths, METER).select("file", "line_no", "row.*")
    none = F.coalesce(F.col("five_hour_idle"), F.lit(False)) | F.col("five_hour.utilization").isNull()
    five, seven = F.when(~none, finite_number(F.col("five_hour.utilization"))), finite_number(F.col("seven_day.utilization"))
    keep = ~none | (F.lit(weekly) & seven.isNotNull())
    out = rows.filter(keep & F.col("ts").isNotNull()).select("account", "identity", *_reading(source, five, seven, F.when(~none, F.col("five_hour.resets_at")), F.col("seven_day.resets_at"), F.col("ts")), F.col("file").alias("log_id"), F.col("line_no"), F.col("line_no").alias("seq"))
    return out.filter("ts_us is not null")


def one_identity(readings: DataFrame) -> DataFrame:
    """The readings, or an error if one log names more than one account."""
    mixed = readings.filter("identity <> ''").groupBy("log_id").agg(F.count_distinct("identity").alias("_ids"))
    checked = mixed.withColumn("_ok", F.when(F.col("_ids") > 1, F.raise_error(F.concat(F.lit("log of several accounts: "), "log_id"))).otherwise(F.lit(True)))
    return readings.join(checked.select("log_id", "_ok"), "log_id", "left").filter("coalesce(_ok, true)").drop("_ok")


def meter_log(spark: SparkSession, paths: Paths, weekly: bool = False) -> DataFrame:
    """A sampler's own log: failed reads are gaps, and a log that mixes accounts is refused."""
    return one_identity(meter_json(spark, paths, "meter", weekly))


def _text_log(spark: SparkSession, paths: Paths, pattern: str, source: str, since: int | None) -> DataFrame:
    part = lambda i: F.regexp_extract("value", pattern, i)
    nothing = F.lit(None).cast("string")
    out = lines(spark, paths).filter(F.col("value").rlike(pattern)).select(nothing.alias("account"), nothing.alias("identity"), *_reading(source, part(2), part(3), nothing, nothing, part(1)), F.col("file").alias("log_id"), "line_no", F.col("line_no").alias("seq"))
    out = out.filter("ts_us is not null")
    return out if since is None else out.filter(F.col("ts_us") >= since)


def gate_log(spark: SparkSession, paths: Paths, since: int | None = None) -> DataFrame:
    """A gate's text log (ok, warn and ceiling lines); it names no resets."""
    return _text_log(spark, paths, GATE_LOG, "gate", since)


def ceiling_log(spark: SparkSession, paths: Paths, since: int | None = None) -> DataFrame:
    return _text_log(spark, paths, CEILING_LOG, "ceiling", since)


#: Format names to readers with one schema.
FORMATS: dict[str, Callable[..., DataFrame]] = {"meter": meter_log, "shared-meter": meter_json, "gate": gate_log, "ceiling": ceiling_log}
#: Sources in order of preference where two read the same minute.
PRIORITY = {"ceiling": 0, "gate": 0, "meter": 0, "shared-meter": 1}


def read_log(spark: SparkSession, fmt: str, paths: Paths, since: int | None = None) -> DataFrame:
    """Readings of a log by format name; ``since`` applies to every format."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown log format {fmt!r}; known: {', '.join(sorted(FORMATS))}")
    out = FORMATS[fmt](spark, paths)
    return out if since is None else out.filter(F.col("ts_us") >= since)


def account_readings(primary: DataFrame, extra: Sequence[DataFrame], legacy: DataFrame | None = None, until: int | None = None) -> DataFrame:
    """One account's readings: primary and extra logs, an older log only before the primary's first reading, one a minute."""
    from tidewater.operators.dedupe import one_a_minute, union_all

    parts = [primary, *extra]
    if legacy is not None:
        first = primary.agg(F.min("ts_us").alias("_first"))
        parts.append(legacy.join(F.broadcast(first), F.col("_first").isNull() | (F.col("ts_us") < F.col("_first"))).drop("_first"))
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    out = one_a_minute(union_all(*parts).withColumn("priority", F.coalesce(F.try_element_at(ranks, "source"), F.lit(9))))
    return out if until is None else out.filter(F.col("ts_us") <= until)


def usage_rows(spark: SparkSession, paths: Paths) -> DataFrame:
    """Usage-log rows in order; a line that does not parse, or lacks an instant, has null figures and so breaks pairs."""
    rows = json_lines(spark, paths, "ts string, five_hour double, five_resets_at string, seven_day double, seven_resets_at string", "null")
    at = {c: parse_instant(F.col(f"row.{s}")) for c, s in (("ts_us", "ts"), ("resets_us", "five_resets_at"), ("seven_resets_us", "seven_resets_at"))}
    good = at["ts_us"].isNotNull() & at["resets_us"].isNotNull() & at["seven_resets_us"].isNotNull()
    return rows.select(F.col("file").alias("account"), F.col("line_no").alias("seq"), *[F.when(good, e).alias(c) for c, e in at.items()], F.when(good, F.col("row.five_hour")).alias("five_hour"), F.when(good, F.col("row.seven_day")).alias("seven_day"))


# --- API bodies and headers ----------------------------------------------------------------------------


def usage_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Readings and schema problems of JSON bodies, telling an explicit null from a missing key."""
    v = F.try_parse_json(body)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(F.col("_v"), p, "variant"))
    is_object = F.startswith(kind("$"), F.lit("OBJECT"))
    out = bodies.withColumn("_v", v)
    problems: list[Column] = [F.when(~F.coalesce(is_object, F.lit(False)), "response is not an object")]
    figures: dict[str, Column] = {}
    for name in ("five_hour", "seven_day"):
        there = kind(f"$.{name}")
        null = F.coalesce(there == "VOID", F.lit(False))
        bucket = F.coalesce(F.startswith(there, F.lit("OBJECT")), F.lit(False))
        allowed = null if name == "five_hour" else F.lit(False)
        problems.append(F.when(~bucket & ~allowed, f"no {name} bucket"))
        for key, good, said in (("utilization", r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$", "is not a number"), ("resets_at", r"^(STRING|VOID)$", "is not a string")):
            k = kind(f"$.{name}.{key}")
            problems.append(F.when(bucket & k.isNull(), f"{name}.{key} missing").when(bucket & ~k.rlike(good), f"{name}.{key} {said}"))
        number = kind(f"$.{name}.utilization").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        figures[name] = F.when(number, F.try_variant_get(F.col("_v"), f"$.{name}.utilization", "double"))
        figures[f"{name}_resets_at"] = F.when(kind(f"$.{name}.resets_at") == "STRING", F.try_variant_get(F.col("_v"), f"$.{name}.resets_at", "string"))
    weekly = F.coalesce(kind("$.five_hour") == "VOID", F.lit(False)) & figures["seven_day"].isNotNull()
    return out.withColumns(figures | {"weekly_only": weekly, "problems": F.array_compact(F.array(*problems))}).drop("_v")


def header_readings(rows: DataFrame, prefix: str, headers: str = "headers") -> DataFrame:
    """Readings from a map of response headers: fractions to percent, epochs to instants; missing ones are named."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    get = lambda k: F.try_element_at(F.col("_h"), F.lit(prefix + k))
    out = rows.withColumn("_h", low)
    five, seven = get("5h-utilization").try_cast("double") * 100, get("7d-utilization").try_cast("double") * 100
    weekly = seven.isNotNull() & get("5h-utilization").isNull() & get("5h-reset").isNull() & get("5h-status").isNull()
    missing = [F.when(get(k).isNull() & (~weekly if k.startswith("5h") else F.lit(True)), prefix + k + " missing") for k in ("5h-utilization", "5h-reset", "7d-utilization", "7d-reset")]
    at = lambda k: (get(k).try_cast("bigint") * 1_000_000)
    return out.withColumns({"five_hour": five, "seven_day": seven, "resets_us": at("5h-reset"), "seven_resets_us": at("7d-reset"), "weekly_only": weekly, "problems": F.array_compact(F.array(*missing))}).drop("_h")


# --- transcripts -----------------------------------------------------------------------------------------


def transcripts(spark: SparkSession, paths: Paths, since: str | None = None) -> DataFrame:
    """Transcript lines below a root, numbered; ``since`` (a timestamp) skips files not written to since."""
    cut = numbered_lines(spark, paths, pathGlobFilter="*.jsonl*", modifiedAfter=since).withColumnRenamed("file", "path")
    rows = cut.withColumn("row", F.from_json("value", TRANSCRIPT)).filter("row is not null and startswith(ltrim(value), '{')")
    # An extract holds the lines of many transcripts, each line naming its own.
    return rows.select(F.coalesce("row.file", "path").alias("file"), F.col("line_no").cast("bigint").alias("line_no"), *[F.col(f"row.{c}").alias(c) for c in ("type", "timestamp", "isSidechain", "entrypoint", "remoteSourced", "sessionId", "message")])


def usage_lines(rows: DataFrame) -> DataFrame:
    """Assistant lines with an id and a usage: five counters, the first null-safe."""
    u = F.col("message.usage")
    hour = F.coalesce(u["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0))
    out = rows.filter("type = 'assistant' and message.id <> '' and message.usage is not null and timestamp is not null")
    return out.select("file", "line_no", F.col("message.id").alias("message_id"), parse_instant(F.col("timestamp")).alias("ts_us"), F.coalesce("message.model", F.lit("unknown")).alias("model"), F.coalesce("entrypoint", F.lit("")).alias("entrypoint"), F.coalesce("remoteSourced", F.lit(False)).alias("remote"), F.coalesce(u["input_tokens"], F.lit(0)).alias("input"), F.coalesce(u["output_tokens"], F.lit(0)).alias("output"), F.coalesce(u["cache_read_input_tokens"], F.lit(0)).alias("cache_read"), cache_write_total(u["cache_creation_input_tokens"], u["cache_creation"]["ephemeral_5m_input_tokens"], hour).alias("cache_write"), hour.alias("cache_write_1h"), F.contains("file", F.lit("/subagents/")).alias("subagent"))


def turns(rows: DataFrame) -> DataFrame:
    """One row a message over all transcripts: first line's name, largest counters of its file, first file wins."""
    from tidewater.operators.dedupe import turns_from_lines

    used = usage_lines(rows).filter("ts_us is not null").withColumn("file_ord", F.col("file"))
    return turns_from_lines(used, ["input", "output", "cache_read", "cache_write", "cache_write_1h"], first=["ts_us", "model", "entrypoint", "subagent"], flags=["remote"]).drop("file_ord")


def requests(rows: DataFrame) -> DataFrame:
    """Timed requests: the user line that set each off (per side chain), first and last block, largest output; first file wins."""
    from pyspark.sql.window import Window as W

    from tidewater.operators.dedupe import first_by

    seen = rows.filter("type in ('user', 'assistant') and timestamp is not null").withColumns({"t_us": parse_instant(F.col("timestamp")), "side": F.coalesce("isSidechain", F.lit(False))})
    w = W.partitionBy("file", "side").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    timed = seen.withColumn("trigger_us", F.last(F.when(F.col("type") == "user", F.col("t_us")), True).over(w)).filter("type = 'assistant' and message.id <> '' and message.usage is not null and trigger_us is not null")
    u = F.col("message.usage")
    first = lambda c: F.min_by(c, "line_no")
    out = timed.groupBy("file", F.col("message.id").alias("message_id")).agg(first("trigger_us").alias("start_us"), F.min("t_us").alias("first_us"), F.max("t_us").alias("end_us"), F.max(F.coalesce(u["output_tokens"], F.lit(0))).alias("output"), first(F.col("message.model")).alias("model"), first(F.coalesce("entrypoint", F.lit("unknown"))).alias("entrypoint"), first("side").alias("side"), first(u["speed"]).alias("speed"))
    return first_by(out, ["message_id"], ["file"])


# --- dimensions and histories ---------------------------------------------------------------------------


def history(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """A stored history; lines that do not parse are skipped and never removed."""
    return json_lines(spark, paths, schema).select("row.*")


def strict_history(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """A history in which a bad line is an error that names its file and line."""
    return json_lines(spark, paths, schema, "fail").select("row.*")


def excluded_runs(spark: SparkSession, paths: Paths) -> DataFrame:
    """(account, start_us, end_us, ...) of excluded spans, rows without all three left out."""
    rows = strict_history(spark, paths, "account string, start string, end string, kind string, outcome string, model string, tokens_per_pct double, source string")
    out = rows.withColumns({"start_us": parse_instant(F.col("start")), "end_us": parse_instant(F.col("end"))}).drop("start", "end")
    return out.filter("account is not null and start_us is not null and end_us is not null").orderBy("account", "start_us")


def document_rows(spark: SparkSession, path: str, schema: str, field: str = "rows") -> DataFrame:
    """The rows kept in one field of a JSON document."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(field).alias("_r")).select("_r.*")


def launches(spark: SparkSession, paths: Paths) -> DataFrame:
    """(at_us, name, session) of a launch log whose columns vary: a 40-hex column ends the name, one starts with session_."""
    parts = lines(spark, paths).withColumn("c", F.split("value", "\t"))
    sha = F.array_position(F.transform("c", lambda x: x.rlike("^[0-9a-f]{40}$").cast("int")), 1)
    session = F.get(F.filter("c", lambda x: x.startswith("session_")), F.lit(0))
    out = parts.select(parse_instant(F.col("c")[0]).alias("at_us"), F.when(sha >= 3, F.array_join(F.slice("c", F.lit(2), F.greatest(sha - 2, F.lit(1)).cast("int")), "-")).alias("name"), session.alias("session"))
    return out.na.drop()


def run_logs(spark: SparkSession, paths: Paths, ends: str) -> DataFrame:
    """Runs of an operations log: all lines up to one that matches ``ends`` belong together."""
    before = F.sum(F.col("value").rlike(ends).cast("bigint")).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    rows = lines(spark, paths).withColumn("run", F.coalesce(before, F.lit(0)))
    out = rows.groupBy("file", "run").agg(F.count("*").alias("lines"), F.min_by("value", "line_no").alias("first"), F.max_by("value", "line_no").alias("last"))
    return out.filter(F.col("last").rlike(ends))


#: What matters of a page for its tables: comments and code, which hold no text, and tags.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9]*)([^>]*)>", re.I | re.S)
_SPAN = re.compile(r"\b(col|row)span\s*=\s*[\"']?\s*(\d+)", re.I)


def table_cells(page: str) -> list[tuple[int, int, int, str, str]]:
    """(table, row, column, first, text) of every cell, by the grid that row and column spans make.

    ``first`` is the cell's text up to the first tag inside it that follows a text. A cell ends where the next cell,
    row or table does, if nothing else ends it; text belongs to the innermost table's cell.
    """
    out: list[tuple[int, int, int, str, str]] = []
    grids: list[dict] = []
    tables, at = 0, 0

    def leave(grid: dict) -> None:
        if (cell := grid.pop("cell", None)) is not None:
            out.append((grid["table"], *cell["place"], cell["texts"][0] if cell["texts"] else "", " ".join(cell["texts"])))

    def read(text: str) -> None:
        if grids and "cell" in grids[-1] and (text := " ".join(unescape(text).split())):
            grids[-1]["cell"]["texts"].append(text)

    for m in _MARKUP.finditer(page):
        read(page[at : m.start()])
        at = m.end()
        closing, tag = m[2] == "/", (m[3] or "").lower()
        if tag == "table":
            if closing and grids:
                leave(grids.pop())
            elif not closing:
                grids.append({"table": tables, "row": -1, "taken": set()})
                tables += 1
        elif tag in ("tr", "td", "th") and grids:
            grid = grids[-1]
            leave(grid)
            if tag == "tr" and not closing:
                grid["row"] += 1
            elif tag != "tr" and not closing:
                spans = {k.lower(): min(int(v), 1000) or 1 for k, v in _SPAN.findall(m[4])}
                row, column = max(grid["row"], 0), 0
                while (row, column) in grid["taken"]:
                    column += 1
                grid["taken"] |= {(row + i, column + j) for i in range(spans.get("row", 1)) for j in range(spans.get("col", 1))}
                grid["cell"] = {"place": (row, column), "texts": []}
    read(page[at:])
    while grids:
        leave(grids.pop())
    return out


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Cells of every table of HTML pages: (id, table, row, column, first, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(key, *c) for c in table_cells(page or "")]
            kinds = [b.schema.field(0).type, *[pa.int32()] * 3, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "table", "row", "column", "first", "text"])

    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("_html"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, table int, row int, column int, first string, text string")


def price_table(pages: DataFrame, id_col: str, html_col: str, model: Callable[[Column], Column], least_models: int = 2) -> DataFrame:
    """(id, model, class, usd) of each page's main price table: all five classes in its head, most models, first on a tie.

    A listed model with a missing or zero price is an error, so no half-read table gets through.
    """
    # All that is asked of a page stands in its own cells: they are parsed and shuffled once, by page, and nothing is broadcast.
    label = F.lower(F.regexp_replace("text", "-", " "))
    write = F.contains(label, F.lit("write"))
    kind = F.when(write & label.rlike("5 ?m"), "cache_write").when(write & label.rlike("1 ?h"), "cache_write_1h").when(label.rlike("hit|cache read"), "cache_read").when(F.contains(label, F.lit("output")), "output").when(F.contains(label, F.lit("input")) & ~F.contains(label, F.lit("cache")), "input")
    cells = html_tables(pages, id_col, html_col).filter("id is not null").repartition("id")
    cells = cells.withColumns({"_head": F.when(F.col("row") == 0, kind), "_name": F.when((F.col("column") == 0) & (F.col("row") > 0), model(F.col("first")))})
    of = lambda *by: W.partitionBy("id", *by)
    complete = cells.withColumn("_classes", F.size(F.collect_set("_head").over(of("table")))).filter("_classes = 5")
    new = F.row_number().over(of("table", "_name").orderBy("row")) == 1
    counted = complete.withColumn("_new", (F.col("_name").isNotNull() & new).cast("int")).withColumn("_models", F.sum("_new").over(of("table"))).filter(F.col("_models") >= least_models)
    main = counted.withColumn("_main", F.min(F.struct(-F.col("_models"), F.col("table").alias("table"))).over(of())).filter(F.col("table") == F.col("_main.table"))
    price = F.regexp_replace(F.regexp_extract("text", r"\$\s*([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    rows = main.withColumns({"model": F.max("_name").over(of("row")), "class": F.max("_head").over(of("column"))}).filter("row > 0 and model is not null and class is not null")
    checked = F.when(price > 0, price).otherwise(F.raise_error(F.concat(F.lit("no price in "), "text")).cast("double"))
    return rows.select("id", "model", "class", checked.alias("usd"))


def from_snapshot(spark: SparkSession, paths: Paths, by: str, columns: Sequence[str]) -> DataFrame:
    """The rows of snapshots (by, columns, rows), each value by its column's name; ``by`` and ``columns`` are DDL."""
    docs = spark.read.schema(f"{by}, columns array<string>, rows array<array<string>>").json(paths)
    cells = docs.select(by.split()[0], F.explode("rows").alias("_row"), "columns").withColumn("_m", F.map_from_arrays("columns", "_row"))
    return cells.select(by.split()[0], *[F.try_element_at("_m", F.lit(c.split()[0])).cast(c.split()[1]).alias(c.split()[0]) for c in columns])


# --- archives -----------------------------------------------------------------------------------------------


def archive_lines(spark: SparkSession, paths: Paths, keep: Sequence[str]) -> DataFrame:
    """(archive, member, line_no, row) of the JSON-lines members of .tar, .tar.gz, .tgz and .tar.zst archives.

    Members stream through the task; of each line only the ``keep`` keys stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = io.BytesIO(data)
                stream = zstandard.ZstdDecompressor().stream_reader(raw) if path.endswith(".zst") else raw
                with tarfile.open(fileobj=stream, mode="r|" if path.endswith((".zst", ".tar")) else "r|gz") as tar:
                    for member in tar:
                        if not member.isfile() or not member.name.endswith(".jsonl"):
                            continue
                        out = []
                        for i, line in enumerate(tar.extractfile(member) or ()):
                            try:
                                d = json.loads(line)
                            except ValueError:
                                continue
                            if isinstance(d, dict):
                                out.append((i, json.dumps({k: d[k] for k in keep if k in d}, sort_keys=True)))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([member.name] * len(out), pa.string()), pa.array([i for i, _ in out], pa.int64()), pa.array([r for _, r in out], pa.string())], ["archive", "member", "line_no", "row"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.filter(F.col("path").rlike(r"\.(tar|tar\.gz|tgz|tar\.zst)$")).select("path", "content").mapInArrow(run, "archive string, member string, line_no bigint, row string")


def cache_archives(spark: SparkSession, paths: Paths, keep: Sequence[str], cache: str) -> int:
    """Add the archives that a Parquet cache does not hold yet, by path and size; returns how many it added."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    try:
        known = spark.read.parquet(f"{cache}/manifest")
        files = files.join(known, ["path", "length"], "left_anti")
    except Exception as e:  # noqa: BLE001  a cache that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = [r.path for r in files.select("path").collect()]  # names of new archives only
    if new:
        archive_lines(spark, new, keep).write.mode("append").partitionBy("archive").parquet(f"{cache}/lines")
        files.filter(F.col("path").isin(new)).write.mode("append").parquet(f"{cache}/manifest")
    return len(new)
