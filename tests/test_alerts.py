"""The alert automaton against a minute-by-minute version, in batch and as a stream with timers."""

import datetime as dt
import random

import pytest

from tidewater.streaming import alerts
from tidewater.streaming.alerts import Incident, Rules

MINUTE = 60_000_000
RULES = Rules(threshold=3, stale_us=60 * MINUTE, immediate=frozenset({"lock"}))


def plain(reports, until, rules):
    """Every minute: what has failed for how long, from the reports so far."""
    out, held, is_open = [], set(), False
    for at in range(0, until + 1, MINUTE):
        so_far = [r for r in reports if r[0] <= at]
        if not so_far:
            continue
        streak = 0
        for r in so_far:
            streak = streak + 1 if r[1] else 0
        present = {"runs"} if streak >= rules.threshold or so_far[-1][2] else set()
        counted = set(present)
        for k in set(so_far[-1][3]):
            since = at
            for r in reversed(so_far):
                if k not in r[3]:
                    break
                since = r[0]
            present.add(k)
            if k in rules.immediate or at - since >= rules.stale_us:
                counted.add(k)
        if is_open and not present:
            out.append((at, "recovered", ",".join(sorted(held))))
            held, is_open = set(), False
        elif is_open:
            gone = {h for h in held if h not in present and not any(p.startswith(h + "/") for p in present)}
            held -= gone
            if gone:
                out.append((at, "partly recovered", ",".join(sorted(gone))))
            new = {k for k in counted if k not in held and k.split("/")[0] not in held and not (k == "page/age" and "runs" in held | counted)}
            if new:
                held |= counted
                out.append((at, "further problem", ",".join(sorted(new))))
        elif counted:
            held, is_open = set(counted), True
            out.append((at, "needs attention", ",".join(sorted(counted))))
    return out


def made(seed, n=60):
    r, at, out, kinds = random.Random(seed), 0, [], set()
    for _ in range(n):
        at += r.choice([1, 5, 10, 30, 90]) * MINUTE
        for k in ("meters/a", "meters/b", "page/age", "lock", "disk"):
            if r.random() < 0.25:
                kinds ^= {k}
        out.append((at, r.random() < 0.5, r.random() < 0.05, sorted(kinds)))
    return out


def told(reports, until, rules):
    s, out = Incident(), []
    for r in reports:
        out += s.report(*r, rules)
    return out + s.until(until + 1, rules)


@pytest.mark.parametrize("seed", range(8))
def test_messages_equal_a_minute_by_minute_version(seed):
    reports = made(seed)
    until = reports[-1][0] + 200 * MINUTE
    want = plain(reports, until, RULES)
    assert told(reports, until, RULES) == want and len(want) > 5


def test_threshold_stale_immediate_and_recovery():
    s = Incident()
    assert s.report(0, True, False, [], RULES) == [] and s.report(1, True, False, [], RULES) == []
    assert s.report(2, True, False, [], RULES) == [(2, "needs attention", "runs")]
    assert s.report(3, True, False, ["page/age", "lock"], RULES) == [(3, "further problem", "lock")]
    assert s.until(3 + 61 * MINUTE, RULES) == []  # a stale page is part of failing runs
    assert s.report(4 + 61 * MINUTE, False, False, ["lock"], RULES) == [(4 + 61 * MINUTE, "partly recovered", "runs")]
    assert s.report(5 + 61 * MINUTE, False, False, [], RULES) == [(5 + 61 * MINUTE, "recovered", "lock")]
    assert s.report(6 + 61 * MINUTE, True, True, [], RULES) == [(6 + 61 * MINUTE, "needs attention", "runs")]


def stamp(us):
    return dt.datetime(2026, 1, 1) + dt.timedelta(microseconds=us)


def frame(spark, by_key):
    return spark.createDataFrame([(k, stamp(at), failed, hand, kinds) for k, rs in by_key.items() for at, failed, hand, kinds in rs], alerts.REPORTS)


def test_batch_follows_every_key(spark):
    by_key = {f"k{i}": made(20 + i) for i in range(5)}
    until = max(r[-1][0] for r in by_key.values())
    zero = int((dt.datetime(2026, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    got = sorted((r.key, r.at_us - zero, r.message, r.kinds) for r in alerts.alert_log(frame(spark, by_key), RULES, zero + until).collect())
    assert got == sorted((k, *m) for k, rs in by_key.items() for m in told(rs, until, RULES))


def test_stream_tells_a_stale_kind_without_a_new_report(spark, tmp_path):
    """Key a is told by its timer: only key b's reports move time on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [{"a": [(0, False, False, ["disk"])]}, {"b": [(50 * MINUTE, False, False, ["lock"])]}, {"b": [(70 * MINUTE, False, False, [])]}, {"b": [(90 * MINUTE, False, False, [])]}, {"b": [(95 * MINUTE, False, False, [])], "a": [(94 * MINUTE, False, False, [])]}, {"b": [(200 * MINUTE, False, False, [])]}]
        import os

        for i, part in enumerate(parts):
            frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
            (tmp_path / "in").mkdir(exist_ok=True)
            (file,) = (tmp_path / f"w{i}").glob("*.parquet")
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)
            file.rename(tmp_path / "in" / f"{i}.parquet")
        source = spark.readStream.schema(alerts.REPORTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = alerts.alerts(source, RULES, "1 minute").writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r.key, r.at, r.message, r.kinds) for r in spark.table("alerts").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [("a", stamp(60 * MINUTE), "needs attention", "disk"), ("a", stamp(94 * MINUTE), "recovered", "disk"), ("b", stamp(50 * MINUTE), "needs attention", "lock"), ("b", stamp(70 * MINUTE), "recovered", "lock")]
