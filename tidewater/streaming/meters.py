"""Structured Streaming: stretches as readings arrive, late data within a horizon, held state and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.functions.values import FIVE_HOURS, MINUTE, SECOND

STRETCH_OUT = "account bigint, start_us bigint, end_us bigint, delta_pct double, windows bigint"
STRETCH_STATE = "last_ts bigint, last_five double, last_reset bigint, start bigint, end bigint, total double, windows bigint, open boolean, piece boolean"


def stretches(readings: DataFrame, threshold: float = 10.0, max_gap: int = 15 * MINUTE) -> DataFrame:
    """Closed stretches of a stream of readings, a state of nine numbers an account.

    Readings must come in order within an account (a log's own order); one that is older than the last
    is dropped, as the batch scan drops what is out of log order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [None, None, None, None, None, 0.0, 0, False, True]
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts_us", "seq"], kind="stable")
        for ts, five, reset in zip(rows["ts_us"], rows["five_hour"], rows["resets_us"], strict=True):
            reset = None if pd.isna(reset) else int(reset)
            last_ts, last_five, last_reset = s[:3]
            if last_ts is not None and ts < last_ts:
                continue
            s[:3] = [int(ts), float(five), reset]
            if last_ts is None:
                continue
            apart = last_reset is not None and reset is not None and abs(reset - last_reset) > MINUTE
            past = reset is None and last_reset is not None and ts > last_reset + 5 * SECOND
            early = last_reset is None and last_five > 0 and reset is not None and last_ts < reset - FIVE_HOURS - MINUTE
            if apart or past or early or five < last_five or ts - last_ts > max_gap:
                s[8] = True
                continue
            if not s[7]:
                s[3], s[5], s[6], s[7] = int(last_ts), 0.0, 1, True
            elif s[8]:
                s[6] += 1
            s[8], s[4] = False, int(ts)
            s[5] += float(five - last_five)
            if s[5] >= threshold:
                out.append((key[0], s[3], s[4], s[5], s[6]))
                s[7] = False
        state.update(tuple(s))
        if out:
            yield pd.DataFrame(out, columns=["account", "start_us", "end_us", "delta_pct", "windows"])

    slim = readings.select("account", "ts_us", "seq", "five_hour", "resets_us")
    return slim.groupBy("account").applyInPandasWithState(step, STRETCH_OUT, STRETCH_STATE, "append", GroupStateTimeout.NoTimeout)


def daily_tokens(turns: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Tokens per account, model and UTC day; turns may come ``late``, older days are frozen."""
    day = F.window(F.col(ts), "1 day")
    return turns.withWatermark(ts, late).groupBy("account", "model", day).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns")).select("account", "model", F.col("window.start").alias("day"), "tokens", "turns")


def sliding_rate(turns: DataFrame, ts: str = "ts", length: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    w = F.window(F.col(ts), length, slide)
    return turns.withWatermark(ts, late).groupBy("account", w).agg(F.sum("tokens").alias("tokens")).select("account", F.col("window.end").alias("until"), "tokens")


def first_seen(turns: DataFrame, key: str = "id", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Each id once, within the time that repeats may lag."""
    return turns.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def plausible(readings: DataFrame, ts: str = "ts", slack: str = "5 minutes") -> DataFrame:
    """Readings not stamped ahead of the clock by more than the slack."""
    return readings.filter(F.col(ts) <= F.current_timestamp() + F.expr(f"INTERVAL {slack}"))


def upsert_days(stream: DataFrame, path: str, checkpoint: str, day: str = "day") -> StreamingQuery:
    """Each micro-batch replaces the days it brings; running a batch again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INCIDENT_OUT = "key string, at_us bigint, message string"
INCIDENT_STATE = "failing bigint, told_us bigint, open boolean"


def incidents(checks: DataFrame, threshold: int = 3, remind_us: int = 24 * 3600 * SECOND) -> DataFrame:
    """One alert an incident: after ``threshold`` failures in a row, reminders while it lasts, one recovery.

    ``checks`` is (key, at_us, ok).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failing, told, is_open = state.get if state.exists else (0, 0, False)
        out: list[tuple[Any, ...]] = []
        for at, ok in pd.concat(list(frames)).sort_values("at_us")[["at_us", "ok"]].itertuples(index=False):
            if ok:
                if is_open:
                    out.append((key[0], at, "recovered"))
                failing, is_open = 0, False
                continue
            failing += 1
            if failing >= threshold and not is_open:
                is_open, told = True, at
                out.append((key[0], at, "failing"))
            elif is_open and at - told >= remind_us:
                told = at
                out.append((key[0], at, "still failing"))
        state.update((int(failing), int(told), bool(is_open)))
        if out:
            yield pd.DataFrame(out, columns=["key", "at_us", "message"])

    return checks.groupBy("key").applyInPandasWithState(step, INCIDENT_OUT, INCIDENT_STATE, "append", GroupStateTimeout.NoTimeout)


def replay(readings: DataFrame, until: Iterable[int], run: Callable[[DataFrame, Any], Any], ts: str = "ts_us") -> Any:
    """Backtest: one run for each instant on what was known by then, each fed the last one's state.

    Runs follow each other because their state does; each is a Spark job over its own cut.
    """
    state = None
    for at in until:
        state = run(readings.filter(F.col(ts) <= at), state)
    return state


__all__ = ["daily_tokens", "first_seen", "incidents", "plausible", "replay", "sliding_rate", "stretches", "upsert_days"]
