"""Streams against the batch scans."""

import time

from pyspark.sql import functions as F

from tidewater.operators import ordered
from tidewater.plans import base
from tidewater.streaming import meters


def files(df, folder, parts, key):
    rows = df.orderBy(key).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(query_df, mode="append"):
    q = query_df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return query_df.sparkSession.table("out").collect()


def test_streamed_stretches_equal_the_batch(spark, sf_dir, tmp_path):
    r = base.readings(spark, sf_dir)
    files(r, tmp_path / "in", 3, "ts_us")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(meters.stretches(stream, 10.0, base.MAX_GAP))
    want = ordered.stretches(ordered.reading_pairs(r, base.MAX_GAP))[0].collect()
    key = lambda x: (x.account, x.start_us, x.end_us, x.delta_pct, x.windows)
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_daily_tokens_freeze_late_days(spark, tmp_path):
    rows = [[("a", "m", "2026-09-01 10:00:00", 5), ("a", "m", "2026-09-02 10:00:00", 7)], [("a", "m", "2026-09-09 00:00:00", 1)], [("a", "m", "2026-09-09 01:00:00", 1)], [("a", "m", "2026-09-01 11:00:00", 99), ("a", "m", "2026-09-20 00:00:00", 1)]]
    schema = "account string, model string, ts timestamp, tokens long"
    for part in rows:
        spark.createDataFrame(part, "account string, model string, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {str(r.day)[:10]: r.tokens for r in run(meters.daily_tokens(stream))}
    assert got["2026-09-01"] == 5 and got["2026-09-02"] == 7


def test_incidents_tell_once(spark, tmp_path):
    oks = [True, False, False, False, False, True, False]
    df = spark.createDataFrame([("k", i * 10, ok) for i, ok in enumerate(oks)], "key string, at_us long, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(meters.incidents(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 1000))
    assert sorted((r.at_us, r.message) for r in got) == [(30, "failing"), (50, "recovered")]


def test_upsert_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 6)], "day int, v int")
    df.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        meters.upsert_days(stream, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted((r.day, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5), (2, 6)]


def test_replay_feeds_the_state_on(spark):
    df = spark.createDataFrame([(t,) for t in range(10)], "ts_us long")
    assert meters.replay(df, [2, 5], lambda cut, state: [*(state or []), cut.count()]) == [3, 6]
