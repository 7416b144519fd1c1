"""Documents rebuilt at an instant, claims read by changed file, and run results."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.functions import values as V
from tidewater.operators import documents
from tidewater.sources import claims


def build(spark, readings, now):
    r = spark.createDataFrame(readings, "account string, at int, v int").filter(F.col("at") <= now).repartition(3)
    days = r.groupBy("account", F.floor(F.col("at") / 10).alias("day")).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    top = r.groupBy("account").agg(F.max("v").alias("most")).filter("most > 2")
    return documents.assemble({"days": days, "top": top}, "account", F.lit(now))


ROWS = [("a", 1, 3), ("a", 12, 4), ("a", 25, 1), ("b", 3, 1), ("b", 14, 2), ("b", 99, 50)]


def test_two_builds_at_one_instant_are_equal_and_ignore_what_came_later(spark):
    first = sorted(map(tuple, build(spark, ROWS, 30).collect()))
    again = sorted(map(tuple, build(spark, ROWS[::-1][1:] + [("b", 31, 7)], 30).collect()))
    assert first == again
    a, b = (json.loads(x[1]) for x in first)
    assert a == {"generated_at": 30, "key": "a", "days": [{"day": 0, "v": 3, "n": 1}, {"day": 1, "v": 4, "n": 1}, {"day": 2, "v": 1, "n": 1}], "top": [{"most": 4}]}
    assert b["top"] == [] and list(a) == ["generated_at", "key", "days", "top"]


def test_a_changed_reading_changes_its_leaves_only(spark):
    stored, rebuilt = build(spark, ROWS, 30), build(spark, [("a", 1, 3), ("a", 12, 9), *ROWS[2:]], 30)
    got = sorted(map(tuple, documents.rebuilt_diff(stored, rebuilt, "account").select("id", "path", "old", "new").collect()))
    assert got == [("a", "days[1].v", "4", "9"), ("a", "top[0].most", "4", "9")]
    assert documents.rebuilt_diff(stored, build(spark, ROWS, 30), "account").collect() == []


def write(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def session(sid, at):
    return json.dumps({"sessionId": sid, "startedAt": at, "pid": 1})


def told(df):
    return sorted(map(tuple, df.collect()))


def test_only_changed_files_are_read(spark, tmp_path):
    folders = {g: str(tmp_path / g) for g in "ab"}
    write(tmp_path / "a", {f"sessions/{i}.json": session(f"s{i}", 1000 + i) for i in range(6)} | {"history.jsonl": '{"sessionId": "s1", "timestamp": 5000, "display": "x"}\nnot json\n{"sessionId": "s9"}\n{"sessionId": null, "timestamp": 1}\n', "settings.json": "{}"})
    write(tmp_path / "b", {f"sessions/{i}.json": session(f"s{i}", 9000.5 + i) for i in range(2)} | {"history.jsonl": ""})
    cache = str(tmp_path / "cache")
    assert claims.refresh(spark, folders, cache) == 9 and claims.refresh(spark, folders, cache) == 0
    first = told(claims.claims(spark, cache))
    assert len(first) == 9 and ("a", "s1", 5_000_000) in first and ("b", "s0", 9_000_500) in first
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache/claims").rglob("*.parquet")}
    changed = tmp_path / "a/sessions/3.json"
    changed.write_text(session("s3", 7777))
    os.utime(changed, (2_000_000_000,) * 2)
    assert claims.refresh(spark, folders, cache) == 1
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache/claims").rglob("*.parquet")}
    assert len(set(stamps.items()) - set(kept.items())) == 1
    full = str(tmp_path / "full")
    claims.refresh(spark, folders, full)
    assert told(claims.claims(spark, cache)) == told(claims.claims(spark, full)) != first
    (tmp_path / "a/sessions/0.json").unlink()
    assert claims.refresh(spark, folders, cache) == 0
    assert ("a", "s0", 1_000_000) not in told(claims.claims(spark, cache)) and len(told(claims.claims(spark, cache))) == 8


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ({"modelUsage": {"side": {"inputTokens": 9}, "m-20260101[1m]": {"inputTokens": 2, "costUSD": 0.5}, "m": {"inputTokens": 3, "outputTokens": 1, "costUSD": 0.25}}, "duration_ms": 1500}, ("m", 5, 1, 0, 0, 0.75, 1.5, None)),
        ({"modelUsage": {"m[1m]": {"inputTokens": 2, "cacheReadInputTokens": 7}}, "total_cost_usd": 4}, ("m[1m]", 2, 0, 7, 0, 4.0, 0.0, None)),
        ({"modelUsage": {"m": {"costUSD": 1}, "m[1m]": {"inputTokens": None}}, "total_cost_usd": 4}, ("m", 0, 0, 0, 0, None, 0.0, None)),
        ({"modelUsage": {"m-5": {"inputTokens": 2}}}, (None, None, None, None, None, None, None, "no usage for m")),
        ({"usage": {"input_tokens": 3, "cache_creation_input_tokens": 2}, "total_cost_usd": 1.5}, ("m", 3, 0, 0, 2, 1.5, 0.0, None)),
        ({"is_error": True, "subtype": "limit"}, (None, None, None, None, None, None, None, "error result: limit")),
    ],
)
def test_run_results(spark, text, want):
    df = spark.createDataFrame([(json.dumps(text),)], "t string").select(V.run_result(F.col("t"), F.lit("m")).alias("r")).select("r.*")
    assert tuple(df.first()) == want


def test_text_that_is_no_result(spark):
    df = spark.createDataFrame([("oops",), (None,), ("[1]",)], "t string").select(V.run_result(F.col("t"), F.lit("m")).alias("r"))
    assert {r.r.problem for r in df.collect()} == {"not a result"}
