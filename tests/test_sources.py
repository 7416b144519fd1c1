"""Readers and writers on literal files."""

import gzip
import io
import json
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from tidewater.sources import readers, sinks


def put(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def reading(ts, five, seven=10, **more):
    return {"ts": ts, "identity": "a", "five_hour": {"utilization": five, "resets_at": "2026-09-01T05:00:00Z"}, "seven_day": {"utilization": seven, "resets_at": None}} | more


def test_meter_log_skips_corrupt_lines_and_idle_readings(spark, tmp_path):
    path = put(tmp_path / "m.jsonl", reading("2026-09-01T00:00:00Z", 5), "{torn", reading("2026-09-01T00:01:00", None), reading("2026-09-01T00:02:00Z", 0, five_hour_idle=True), {"error": "429"}, reading("2026-09-01T02:03:00+02:00", 7))
    got = readers.meter_log(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.five_hour) for r in got] == [(0, 5.0), (5, 7.0)]
    assert got[1].ts_us - got[0].ts_us == 180_000_000
    weekly = readers.meter_log(spark, path, weekly=True).orderBy("seq").collect()
    assert [(r.seq, r.five_hour) for r in weekly] == [(0, 5.0), (2, None), (3, None), (5, 7.0)]


def test_meter_log_refuses_two_accounts(spark, tmp_path):
    path = put(tmp_path / "m.jsonl", reading("2026-09-01T00:00:00Z", 5), reading("2026-09-01T00:01:00Z", 6, identity="b"))
    with pytest.raises(Exception, match="several accounts"):
        readers.meter_log(spark, path).collect()


def test_text_logs(spark, tmp_path):
    gate = put(tmp_path / "g.log", "2026-09-01T00:00:00Z ok five_hour=5% seven_day=9%", "2026-09-01T00:01:00Z paused", "2026-09-01T00:02:00Z HARD CEILING (five-hour) five_hour=95% seven_day=20%", "nonsense ok five_hour=1% seven_day=1%")
    assert [(r.five_hour, r.seven_day) for r in readers.gate_log(spark, gate).orderBy("seq").collect()] == [(5.0, 9.0), (95.0, 20.0)]
    ceiling = put(tmp_path / "c.log", "2026-09-01T00:00:00Z 5-hour 7% / 7-day 3%", "x")
    assert [(r.five_hour, r.resets_us) for r in readers.read_log(spark, "ceiling", ceiling).collect()] == [(7.0, None)]
    assert readers.read_log(spark, "ceiling", ceiling, since=2**62).count() == 0
    with pytest.raises(ValueError, match="unknown log format"):
        readers.read_log(spark, "nope", ceiling)


def test_rows_that_do_not_parse_break_pairs(spark, tmp_path):
    row = {"ts": "2026-09-01T00:00:00Z", "five_hour": 1, "five_resets_at": "2026-09-01T05:00:00Z", "seven_day": 2, "seven_resets_at": "2026-09-07T00:00:00Z"}
    got = readers.usage_rows(spark, put(tmp_path / "u.jsonl", row, "{", row | {"ts": "bad"}, row)).orderBy("seq").collect()
    assert [r.five_hour for r in got] == [1.0, None, None, 1.0]


def line(mid, ts, out, **more):
    return {"type": "assistant", "timestamp": ts, "message": {"id": mid, "model": "m-1", "usage": {"input_tokens": 3, "output_tokens": out, "cache_creation_input_tokens": 0, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 2}}}} | more


def test_transcripts_one_row_a_message(spark, tmp_path):
    put(tmp_path / "a.jsonl", {"type": "user", "timestamp": "2026-09-01T00:00:00Z"}, line("x", "2026-09-01T00:00:05Z", 2), line("x", "2026-09-01T00:00:09Z", 300, remoteSourced=True), "{bad", line("y", "2026-09-01T00:00:20Z", 9, isSidechain=True))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps(line("x", "2026-09-02T00:00:00Z", 999)) + "\n")
    rows = readers.transcripts(spark, str(tmp_path))
    got = {r.message_id: r for r in readers.turns(rows).collect()}
    assert set(got) == {"x", "y"} and got["x"].output == 300 and got["x"].cache_write == 6 and got["x"].remote and not got["y"].remote
    timed = {r.message_id: r for r in readers.requests(rows).collect()}
    assert set(timed) == {"x"} and timed["x"].end_us - timed["x"].start_us == 9_000_000 and timed["x"].output == 300


def test_histories(spark, tmp_path):
    path = put(tmp_path / "h.jsonl", {"a": 1}, "{", {"a": 2})
    assert [r.a for r in readers.history(spark, path, "a int").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception, match="not a JSON object"):
        readers.strict_history(spark, path, "a int").collect()
    runs = put(tmp_path / "r.jsonl", {"account": "a", "start": "2026-09-01T01:00:00Z", "end": "2026-09-01T02:00:00Z"}, {"account": "a"})
    assert readers.excluded_runs(spark, runs).count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"n": 1}, {"n": 2}]}))
    assert readers.document_rows(spark, str(tmp_path / "d.json"), "n:int").count() == 2


def test_launches_and_run_logs(spark, tmp_path):
    sha = "0123456789" * 4
    log = put(tmp_path / "s.tsv", f"2026-09-01T00:00:00Z\tmy\tjob\t{sha}\tsession_1", f"2026-09-01T00:00:00Z\t{sha}\tsession_2", "x\ty")
    assert [tuple(r)[1:] for r in readers.launches(spark, log).collect()] == [("my-job", "session_1")]
    runs = readers.run_logs(spark, put(tmp_path / "o.log", "a", "b", "DONE", "c", "DONE", "open"), "^DONE").orderBy("run").collect()
    assert [(r.lines, r.first) for r in runs] == [(3, "a"), (2, "c")]


def test_usage_bodies_tell_null_from_missing(spark):
    rows = [(1, '{"five_hour": null, "seven_day": {"utilization": 5, "resets_at": "x"}}'), (2, '{"seven_day": {"utilization": true}}'), (3, "[]"), (4, '{"five_hour": {"utilization": 1.5, "resets_at": null}, "seven_day": {"utilization": null, "resets_at": 7}}')]
    got = {r.id: r for r in readers.usage_bodies(spark.createDataFrame(rows, "id int, body string"), "body").collect()}
    assert got[1].weekly_only and got[1].seven_day == 5 and got[1].problems == []
    assert not got[2].weekly_only and got[2].seven_day is None and set(got[2].problems) == {"no five_hour bucket", "seven_day.utilization is not a number", "seven_day.resets_at missing"}
    assert got[3].problems[0] == "response is not an object"
    assert got[4].five_hour == 1.5 and got[4].problems == ["seven_day.resets_at is not a string"]


def test_header_readings(spark):
    rows = spark.createDataFrame([(1, {"P-5H-Utilization": "0.25", "p-5h-reset": "100", "p-7d-utilization": "0.5", "p-7d-reset": "200"}), (2, {"p-7d-utilization": "0.5"})], "id int, headers map<string,string>")
    got = {r.id: r for r in readers.header_readings(rows, "p-").collect()}
    assert (got[1].five_hour, got[1].resets_us, got[1].problems) == (25.0, 100_000_000, [])
    assert got[2].weekly_only and got[2].problems == ["p-7d-reset missing"]


def test_price_table_takes_the_main_table(spark):
    head = "<tr><th>Model</th><th>Base input</th><th>5m cache writes</th><th>1h cache writes</th><th>Cache hits</th><th>Output</th></tr>"
    row = lambda n, p: f"<tr><td>{n}<span>words</span></td>" + "".join(f"<td>${p * k} / MTok</td>" for k in range(1, 6)) + "</tr>"
    page = f"<table>{head}{row('Model A', 9)}</table><table>{head}{row('Model A', 1)}{row('Model B', 2)}</table><table><tr><td>x</td></tr></table>"
    pages = spark.createDataFrame([(1, page)], "id int, html string")
    name = lambda c: F.when(c.startswith("Model "), F.lower(F.replace(c, F.lit(" "), F.lit("-"))))
    got = {(r.model, r["class"]): r.usd for r in readers.price_table(pages, "id", "html", name).collect()}
    assert got[("model-b", "output")] == 10 and got[("model-a", "input")] == 1 and len(got) == 10
    with pytest.raises(Exception, match="no price in"):
        readers.price_table(spark.createDataFrame([(1, page.replace("$2 ", "free "))], "id int, html string"), "id", "html", name).collect()


def test_archives_and_cache(spark, tmp_path):
    def tar(compress):
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w") as t:
            data = b'{"a": 1, "secret": 2}\nbad\n{"a": 3}\n'
            info = tarfile.TarInfo("p/x.jsonl")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        return compress(raw.getvalue())

    folder = tmp_path / "arch"
    folder.mkdir()
    (folder / "a.tar.zst").write_bytes(tar(zstandard.ZstdCompressor().compress))
    (folder / "b.tgz").write_bytes(tar(gzip.compress))
    got = readers.archive_lines(spark, str(folder), ["a"]).collect()
    assert sorted((r.line_no, r.row) for r in got) == [(0, '{"a": 1}')] * 2 + [(2, '{"a": 3}')] * 2
    cache = str(tmp_path / "cache")
    assert readers.cache_archives(spark, str(folder), ["a"], cache) == 2
    assert readers.cache_archives(spark, str(folder), ["a"], cache) == 0
    assert spark.read.parquet(f"{cache}/lines").count() == 4


def test_sinks(spark, tmp_path):
    target = str(tmp_path / "doc.json")
    sinks.write_document(target, {"b": 1, "a": [2]})
    assert json.load(open(target)) == {"a": [2], "b": 1} and open(target).read().index('"a"') < open(target).read().index('"b"')
    store, rows = str(tmp_path / "store"), spark.createDataFrame([("x", 1, 5), ("x", 1, 6), ("y", 1, 7)], "id string, ts long, v long")
    sinks.merge_new(rows, store, ["id", "ts"], ["v"])
    sinks.merge_new(rows.union(spark.createDataFrame([("z", 1, 1)], rows.schema)), store, ["id", "ts"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(store).collect())) == [("x", 1, 5), ("y", 1, 7), ("z", 1, 1)]
    days = str(tmp_path / "days")
    day = lambda *r: spark.createDataFrame(list(r), "day int, v int")
    sinks.overwrite_days(day((1, 1), (2, 2), (3, 3)), days, 0)
    sinks.overwrite_days(day((1, 9), (3, 9)), days, 2)
    assert sorted((r.day, r.v) for r in spark.read.parquet(days).collect()) == [(1, 1), (2, 2), (3, 9)]
    sinks.extract(rows.withColumn("identity", F.col("id")), str(tmp_path / "ex"), ["v"])
    assert spark.read.json(str(tmp_path / "ex")).columns == ["v", "identity"]
    assert [r.outlier for r in sinks.mark(day((1, 1), (2, 2)), "day", 2).orderBy("day").collect()] == [False, True]


def test_lines_of_many_blocks_have_the_numbers_of_one_reader(spark, tmp_path):
    import gzip
    import random

    r = random.Random(2)
    texts = {}
    for name in ("a.log", "b.log", "deep/c.log", "empty.log"):
        rows = [] if name == "empty.log" else ["".join(r.choice("xyz é") for _ in range(r.randrange(60))) + r.choice(["", "\r"]) for _ in range(3000)]
        texts[name] = "\n".join(rows) + ("" if name == "b.log" else "\n")
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(texts[name].encode())
    (tmp_path / "z.log.gz").write_bytes(gzip.compress(texts["a.log"].encode()))
    texts["z.log.gz"] = texts["a.log"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = readers.lines(spark, str(tmp_path))
        tasks = spark.read.text(str(tmp_path), recursiveFileLookup=True).rdd.getNumPartitions()
        got = sorted((x.file.rsplit(f"{tmp_path.name}/", 1)[1], x.line_no, x.value) for x in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((name, i, line.removesuffix("\r")) for name, text in texts.items() for i, line in enumerate(text.split("\n")) if line.removesuffix("\r"))
    assert got == want and tasks > 20


def test_cells_follow_spans_nesting_and_open_ends():
    page = """<table><tr><th rowspan=2>A</th><th colspan="2">B <b>x</b></th></tr><tr><td>c<td>d &amp; e</tr>
    <tr><td>f<table><tr><td>inner</td></tr></table>g</td><!-- <td>no</td> --><td><script>"<td>no</td>"</script>h"""
    assert sorted(readers.table_cells(page)) == [(0, 0, 0, "A", "A"), (0, 0, 1, "B", "B x"), (0, 1, 1, "c", "c"), (0, 1, 2, "d & e", "d & e"), (0, 2, 0, "f", "f g"), (0, 2, 1, "h", "h"), (1, 0, 0, "inner", "inner")]
    assert readers.table_cells("") == [] == readers.table_cells("<td>x</td>")


def test_price_table_parses_a_page_once_and_broadcasts_nothing(spark):
    """Cells of all pages are many: no table of them may go through the driver."""
    heads = ["Model", "Base input", "5m cache writes", "1h cache writes", "Cache hits", "Output tokens"]
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    page = lambda k: "<table>" + line("th", heads) + "".join(line("td", [f"m{i}", *[f"${i + j + k}" for j in range(1, 6)]]) for i in (1, 2, 2)) + "</table>"
    pages = spark.createDataFrame([(k, page(k)) for k in range(3)] + [(None, page(9)), (7, None)], "id int, html string")
    out = readers.price_table(pages, "id", "html", lambda c: c)
    assert len(out.collect()) == 45 and {r.id for r in out.collect()} == {0, 1, 2}
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("MapInArrow") == 1 and "Join" not in optimized


def test_logs_keep_the_order_of_their_lines(spark):
    """The writer of folders sorts by folder; lines of one log must not lose their order by that."""
    from tidewater.plans.files import logged

    df = spark.range(40_000, numPartitions=8).select(F.pmod(F.xxhash64("id"), F.lit(40_009)).alias("at"), (F.col("id") % 23).alias("account"))
    path = logged(df, "account", ["at"], F.lpad(F.col("at").cast("string"), 6, "0"), "ordered")
    logs = {}
    for r in readers.numbered_lines(spark, path).collect():
        logs.setdefault(r.file, []).append((r.line_no, r.value))
    assert len(logs) == 23 and sum(map(len, logs.values())) == 40_000
    for rows in logs.values():
        values = [v for _, v in sorted(rows)]
        assert values == sorted(values)


def test_an_extract_has_few_files_an_identity(spark, tmp_path):
    rows = spark.range(800, numPartitions=8).select((F.col("id") % 5).alias("identity"), F.col("id").alias("v"))
    sinks.extract(rows, str(tmp_path / "few"), ["v"])
    assert len(list((tmp_path / "few").glob("identity=*/*.json"))) == 5
    assert spark.read.json(str(tmp_path / "few")).count() == 800
