"""Alerts of a supervised job: one incident a key, with a clock for each kind of fault.

A report says whether a run failed and which checks fail. Failed runs count after ``threshold`` in a row, or
at once where the exit needs a hand; a kind counts once it has failed for ``stale_us``, or at once if it is
an immediate one. The first thing that counts opens the incident, a further kind and a kind that clears
are told once each, and the incident closes when nothing fails any more.

A kind goes stale by time alone, without another report: in the stream a timer of the key fires, and in the
batch form the automaton is moved to each due instant between reports. Both give the same messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REPORTS = "key string, at timestamp, failed boolean, by_hand boolean, kinds array<string>"
MESSAGES = "key string, at timestamp, message string, kinds string"
STATE = "failures int, failing boolean, open boolean, since bigint, last bigint, clocks map<string,bigint>, held array<string>"
RUNS = "runs"


@dataclass(frozen=True)
class Rules:
    threshold: int = 3
    stale_us: int = 3_600_000_000
    immediate: frozenset[str] = frozenset()
    #: A kind that is part of another while that one is open.
    part_of: tuple[tuple[str, str], ...] = (("page/age", RUNS),)


@dataclass
class Incident:
    failures: int = 0
    failing: bool = False
    open: bool = False
    since: int = 0
    #: The newest instant told of; clocks that were due by then are settled.
    last: int = 0
    clocks: dict[str, int] = field(default_factory=dict)
    held: set[str] = field(default_factory=set)

    def due(self, rules: Rules) -> int | None:
        """When the next clock runs out."""
        return min((t for k, at in self.clocks.items() if k not in rules.immediate and (t := at + rules.stale_us) > self.last), default=None)

    def report(self, at: int, failed: bool, by_hand: bool, kinds: Iterable[str], rules: Rules) -> list[tuple[int, str, str]]:
        out = self.until(at, rules)
        self.failures = self.failures + 1 if failed else 0
        self.failing = self.failures >= rules.threshold or by_hand
        self.clocks = {k: self.clocks.get(k, at) for k in sorted(set(kinds))}
        return out + self.settle(at, rules)

    def until(self, at: int, rules: Rules) -> list[tuple[int, str, str]]:
        """What clocks that run out before ``at`` bring."""
        out = []
        while (t := self.due(rules)) is not None and t < at:
            out += self.settle(t, rules)
        return out

    def settle(self, at: int, rules: Rules) -> list[tuple[int, str, str]]:
        self.last, out = at, []
        runs = {RUNS} if self.failing else set()
        counted = runs | {k for k, t in self.clocks.items() if k in rules.immediate or at - t >= rules.stale_us}
        present = runs | set(self.clocks)
        tell = lambda message, kinds: out.append((at, message, ",".join(sorted(kinds))))
        if self.open and not present:
            tell("recovered", self.held)
            self.open, self.held = False, set()
            return out
        if self.open:
            cleared = {h for h in self.held if not any(p == h or p.split("/")[0] == h for p in present)}
            if cleared:
                self.held -= cleared
                tell("partly recovered", cleared)
            parts = dict(rules.part_of)
            new = {k for k in counted if not {k, k.split("/")[0]} & self.held and parts.get(k) not in self.held | counted}
            if new:
                self.held |= counted
                tell("further problem", new)
        elif counted:
            self.open, self.since, self.held = True, at, set(counted)
            tell("needs attention", counted)
        return out


def _micros(at: Any) -> int:
    return pd.Timestamp(at).value // 1000


def _messages(key: str, rows: Iterable[tuple[int, str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(key, pd.Timestamp(at * 1000), message, kinds) for at, message, kinds in rows], columns=["key", "at", "message", "kinds"])


class _Alerts(StatefulProcessor):
    def __init__(self, rules: Rules, by_event: bool) -> None:
        self.rules, self.by_event = rules, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", STATE)

    def _load(self) -> Incident:
        if not self.state.exists():
            return Incident()
        *numbers, clocks, held = self.state.get()
        return Incident(*numbers, dict(clocks), set(held))

    def _save(self, s: Incident) -> None:
        self.state.update((s.failures, s.failing, s.open, s.since, s.last, s.clocks, sorted(s.held)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = s.due(self.rules)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            out += s.report(_micros(r.at), bool(r.failed), bool(r.by_hand), list(r.kinds), self.rules)
        self._save(s)
        yield _messages(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = s.until(expiredTimerInfo.getExpiryTimeInMs() * 1000 + 1, self.rules)
        self._save(s)
        yield _messages(key[0], out)

    def close(self) -> None:
        pass


def alerts(reports: DataFrame, rules: Rules = Rules(), late: str | None = None) -> DataFrame:
    """Messages of a stream of reports.

    With ``late`` timers follow the watermark, which any key's reports move on; without it they follow the
    clock, and a key that falls silent is still told. Needs the RocksDB state store.
    """
    given = reports.withWatermark("at", late) if late else reports
    return given.groupBy("key").transformWithStateInPandas(_Alerts(rules, bool(late)), MESSAGES, "Append", "EventTime" if late else "ProcessingTime")


def alert_log(reports: DataFrame, rules: Rules = Rules(), until_us: int | None = None) -> DataFrame:
    """All messages of a finished table of reports, clocks followed to ``until_us``."""
    from tidewater.operators.ordered import fold

    def make() -> tuple[Callable, Callable]:
        s = Incident()
        return lambda row: s.report(*row[:3], row[3] if row[3] is not None else [], rules), lambda: s.until(until_us + 1, rules) if until_us is not None else []

    given = reports.select("key", F.unix_micros("at").alias("at_us"), "failed", "by_hand", "kinds")
    return fold(given, ["key"], ["at_us"], make, "key string, at_us bigint, message string, kinds string")
