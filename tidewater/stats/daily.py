"""The detector's daily run and its state: what a day's search finds, holds, measures, carries and withdraws.

A plan is a few accounts that share their limits; a line is one of its ratios. A run on a day knows the
units that ended by its midnight. It starts from the changes measured before, searches every line
for further ones, moves each find to its hour, and holds it: a find on the same line, of the same
sign and near a held one is one day more of it. After ``hold_days`` runs in a row a change is measured, at
the median of its finds; from then on it is fixed. A held one that a run does not find again is withdrawn.

Plans are independent, so a day is one Spark job over all of them, with a plan's few numbers a day in
a group. The state is a table with one partition a day: a run reads the newest day before its own and
replaces its own day only, so running it again changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.cut import dealt
from tidewater.stats.changes import account_step, account_steps, is_flagged, rounds, shuffled, undecided

UNITS = "plan string, line string, account string, t double, num double, den double"
#: One row a change held (kind change), withdrawn that day (withdrawn), and one for the run itself (run).
STATE = (
    "plan string, day int, kind string, line string, sign int, at double, first_at double, last_at double, finds array<struct<at: double, first: double, last: double>>, held_days int, state string, "
    "first_found int, measured_on int, carried boolean, found_today boolean, z double, p double, change_pct double, lo_pct double, hi_pct double, decided_pct double, replaced_by double, changes int, replayed boolean"
)
COLUMNS = [x.split()[0] for x in STATE.replace("struct<at: double, first: double, last: double>", "x").split(", ")]


@dataclass(frozen=True)
class Rules:
    """Fixed values of the method; times in hours."""

    alpha: float = 0.001
    permutations: int = 2000
    most: int = 100_000
    errors: float = 3.0
    #: Shuffles are done only where |z| reaches this.
    screen: float = 2.0
    grid: float = 24.0
    side_days: int = 14
    gap: float = 48.0
    refine: int = 48
    range_z: float = 1.0
    match: float = 168.0
    hold_days: int = 7
    most_changes: int = 12
    seed: int = 7


Plan = dict[str, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Known(Plan):
    """A plan's units before an instant, with the steps told so far: a step rests on the units of its two sides only."""

    def __init__(self, plan: Plan, until: float, told: dict[tuple, dict | None]) -> None:
        cut = {line: {a: tuple(c[u[0] < until] for c in u) for a, u in accounts.items() if (u[0] < until).any()} for line, accounts in plan.items()}
        super().__init__({line: accounts for line, accounts in cut.items() if accounts})  # type: ignore[misc]
        self.until, self.told = until, told


def plan_of(units: pd.DataFrame) -> Plan:
    out: Plan = {}
    for (line, account), f in units.sort_values(["line", "account", "t"]).groupby(["line", "account"]):
        out.setdefault(str(line), {})[str(account)] = tuple(f[c].to_numpy(float) for c in ("t", "num", "den"))  # type: ignore[assignment]
    return out


def step_at(plan: Plan, line: str, tau: float, cuts: Sequence[float], rules: Rules, test: bool = True) -> dict | None:
    """The step that the accounts of a line share at an instant; p is None below the screen or without a test."""
    if not isinstance(plan, Known):
        return _step_at(plan, line, tau, cuts, rules, test)
    lo = max([tau - 24 * rules.side_days, *(b for b in cuts if b < tau)])
    hi = min([tau + 24 * rules.side_days, plan.until, *(b for b in cuts if b > tau)])
    if (key := (line, tau, lo, hi, test)) not in plan.told:
        plan.told[key] = _step_at(plan, line, tau, cuts, rules, test)
    return plan.told[key]


def _step_at(plan: Plan, line: str, tau: float, cuts: Sequence[float], rules: Rules, test: bool) -> dict | None:
    found = {a: x for a, u in plan[line].items() if (x := account_step(*u, tau, cuts, side_days=rules.side_days))}
    if not found:
        return None
    step, variance = (np.array([x[k] for x in found.values()]) for k in (0, 1))
    weight = 1 / variance
    mean, z = float((weight * step).sum() / weight.sum()), float((weight * step).sum() / weight.sum() ** 0.5)
    rest = ((weight * step).sum() - weight * step) / np.sqrt(np.maximum(weight.sum() - weight, 1e-300))
    opposed = ((np.sign(step) != np.sign(mean)) & (np.abs(step) > 1.96 * variance**0.5)).any()
    several = len(found) >= 2
    out = {"line": line, "tau": tau, "step": mean, "z": z, "se": float(weight.sum() ** -0.5), "voting": len(found), "p": None, "agree": several and bool((np.abs(step - mean) <= 2.5 * variance**0.5).all()) and not opposed, "plan_wide": several and bool((np.sign(z) * rest >= 1.96).all())}
    if test and abs(z) >= rules.screen and out["agree"] and out["plan_wide"]:
        far = 0
        for before, done in rounds(rules.permutations, rules.most):
            drawn = [shuffled(x[2], tau, a, rules.seed, before, done - before) for a, x in found.items()]
            top, bottom = sum(d[0] for d in drawn), sum(d[1] for d in drawn)
            far += int((np.abs(top / np.sqrt(bottom)) >= abs(z) * (1 - 1e-12)).sum())
            out["p"] = (1 + far) / (done + 1)
            if not undecided(far, done, rules.alpha, rules.errors):
                break
    return out


def _flagged(r: dict | None, rules: Rules) -> bool:
    return r is not None and r["p"] is not None and is_flagged(r, rules.alpha)


def likely(plan: Plan, line: str, taus: Sequence[float], cuts: Sequence[float], rules: Rules) -> list[float]:
    """The instants at which a line's accounts may share a step that :func:`step_at` tests: its own conditions, a hair wider, at all instants at once."""
    if not taus:
        return []
    told, step, variance = (np.array(x) for x in zip(*[account_steps(*u, taus, cuts, side_days=rules.side_days) for u in plan[line].values()], strict=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(told, 1 / variance, 0.0)
        pull = np.where(told, step / variance, 0.0)
        w, wx = weight.sum(0), pull.sum(0)
        z, rest = wx / w**0.5, (wx - pull) / np.sqrt(np.maximum(w - weight, 1e-300))
        # what no comparison tells apart for want of a number is left to the test itself
        low = (np.abs(z) < rules.screen * (1 - 1e-6)) | (told & ((np.abs(step - wx / w) > 2.5 * (1 + 1e-6) * variance**0.5) | (np.sign(z) * rest < 1.96 * (1 - 1e-6)))).any(0)
    return [t for t, ok in zip(taus, (told.sum(0) >= 2) & ~low, strict=True) if ok]


def search(plan: Plan, until: float, fixed: Sequence[float], rules: Rules) -> list[dict]:
    """Flagged instants of all lines, the smallest p first; each cuts the sides of those near it, which are looked at again."""
    times = [x for line in plan.values() for u in line.values() for x in (u[0][0], u[0][-1])]
    grid = [] if not times else [float(t) for t in np.arange(np.ceil(min(times) / rules.grid) * rules.grid, min(max(times), until) - 24.0 + 1e-9, rules.grid)]
    cuts, found, rows = list(fixed), [], {}
    stale = [(line, t) for line in sorted(plan) for t in grid]
    while stale and len(found) < rules.most_changes:
        for line in sorted(plan):
            apart = [t for at, t in stale if at == line and all(abs(t - c) >= rules.gap for c in cuts)]
            rows |= {(line, t): step_at(plan, line, t, cuts, rules) for t in likely(plan, line, apart, cuts, rules)}
        hits = [r for r in rows.values() if _flagged(r, rules)]
        if not hits:
            break
        best = min(hits, key=lambda r: (max(r["p"], 1 / (rules.permutations + 1)), -abs(r["z"]), r["tau"], r["line"]))
        found.append(best)
        cuts.append(best["tau"])
        stale = [(line, t) for line in sorted(plan) for t in grid if abs(t - best["tau"]) <= 24 * rules.side_days]
        for k in stale:
            rows.pop(k, None)
    return [refine(plan, f, [c for c in cuts if c != f["tau"]], rules) for f in found]


def refine(plan: Plan, find: dict, others: Sequence[float], rules: Rules) -> dict:
    """The hour of the largest |z| around a find, and the hours that are nearly as good."""
    hours = {h: r for k in range(-rules.refine, rules.refine + 1) if (h := find["tau"] + k) is not None and all(abs(h - o) >= rules.gap for o in others) and (r := step_at(plan, find["line"], h, others, rules, test=False)) and r["z"] * find["z"] > 0}
    if not hours:
        return find | {"at": find["tau"], "first": find["tau"], "last": find["tau"], "sign": 1 if find["z"] > 0 else -1}
    at = max(hours, key=lambda h: (round(abs(hours[h]["z"]), 9), -h))
    near = [h for h, r in hours.items() if abs(r["z"]) >= abs(hours[at]["z"]) - rules.range_z]
    return find | {"at": at, "first": min(near), "last": max(near), "sign": 1 if find["z"] > 0 else -1}


def lower_median(x: Iterable[float]) -> float:
    s = sorted(x)
    return s[(len(s) - 1) // 2]


def advance(found: Sequence[dict], previous: Sequence[dict], day: int, rules: Rules, replayed: bool = False) -> tuple[list[dict], list[dict]]:
    """(today's changes, the unmeasured ones of the run before that nothing continues).

    ``found`` has line, sign, at, first, last; ``previous`` rows of :data:`STATE`. Finds take their nearest
    held one in the order of their instants.
    """
    out = [dict(c, carried=True, found_today=None) for c in previous if c["state"] == "measured"]
    free = [c for c in previous if c["state"] != "measured"]
    for f in sorted(found, key=lambda f: (f["at"], f["line"], f["sign"])):
        near = [c for c in free if (c["line"], c["sign"]) == (f["line"], f["sign"]) and abs(c["at"] - f["at"]) <= rules.match]
        old = min(near, key=lambda c: abs(c["at"] - f["at"]), default=None)
        if old is not None:
            free = [c for c in free if c is not old]
        finds = [*(old["finds"] if old else []), {"at": f["at"], "first": f["first"], "last": f["last"]}]
        days = old["held_days"] + 1 if old else 1
        state = "measured" if days >= rules.hold_days else "provisional" if days > 1 else "candidate"
        out.append({"line": f["line"], "sign": f["sign"], "at": lower_median(x["at"] for x in finds), "first_at": min(x["first"] for x in finds), "last_at": max(x["last"] for x in finds), "finds": finds, "held_days": days, "state": state, "first_found": old["first_found"] if old else day, "measured_on": day if state == "measured" else None, "carried": False, "found_today": True, "z": f.get("z"), "p": f.get("p"), "decided_pct": None, "replayed": replayed or bool(old and old["replayed"])})
    return sorted(out, key=lambda c: (c["at"], c["line"])), free


def found_again(plan: Plan, change: dict, breaks: Sequence[float], rules: Rules) -> dict | None:
    """The strongest flagged instant of a carried change's sign in its range, the sides cut at every other change."""
    others = [b for b in breaks if b != change["at"]]
    near = np.arange(np.ceil((change["first_at"] - rules.gap) / rules.grid) * rules.grid, change["last_at"] + rules.gap + 1e-9, rules.grid)
    rows = [step_at(plan, change["line"], float(t), others, rules) for t in near if all(abs(t - change["at"]) <= abs(t - b) for b in others)]
    return min((r for r in rows if _flagged(r, rules) and r["z"] * change["sign"] > 0), key=lambda r: (r["p"], -abs(r["z"])), default=None)


def run_day(plan: Plan, day: int, previous: Sequence[dict], rules: Rules, replayed: bool = False, finder=search) -> list[dict]:  # type: ignore[no-untyped-def]
    """The rows of one plan's run on a day, from the changes of the run before."""
    measured = [c["at"] for c in previous if c["state"] == "measured"]
    changes, gone = advance(finder(plan, 24.0 * day, measured, rules), previous, day, rules, replayed)
    breaks = [c["at"] for c in changes]
    for c in changes:
        if c["carried"] and c["line"] in plan:
            again = found_again(plan, c, breaks, rules)
            c.update(found_today=again is not None, z=again and again["z"], p=again and again["p"])
        own = step_at(plan, c["line"], c["at"], [b for b in breaks if b != c["at"]], rules, test=False) if c["line"] in plan else None
        pct = lambda x: float(100 * np.expm1(x))
        c.update(dict(zip(("change_pct", "lo_pct", "hi_pct"), (pct(own["step"] + k * 1.96 * own["se"]) for k in (0, -1, 1)), strict=True)) if own else {"change_pct": None, "lo_pct": None, "hi_pct": None})
        if c["state"] == "measured" and c["decided_pct"] is None:
            c["decided_pct"] = c["change_pct"]
    rows = [c | {"kind": "change", "replaced_by": None} for c in changes]
    for c in gone:
        near = [o["at"] for o in changes if (o["line"], o["sign"]) == (c["line"], c["sign"]) and abs(o["at"] - c["at"]) <= 24 * rules.side_days]
        rows.append(dict(c, kind="withdrawn", state="withdrawn", found_today=False, replaced_by=min(near, key=lambda a: abs(a - c["at"]), default=None)))
    rows.append({"kind": "run", "changes": len(changes), "replayed": replayed})
    return [{k: None for k in COLUMNS} | r | {"day": day} for r in rows]


def _rounded(x: object) -> object:
    return round(x, 9) if isinstance(x, float) else [{k: round(v, 9) for k, v in f.items()} for f in x] if isinstance(x, list) else x


def _frame(plan: str, rows: Sequence[dict]) -> pd.DataFrame:
    out = pd.DataFrame([{k: _rounded(v) for k, v in (r | {"plan": plan}).items()} for r in rows], columns=COLUMNS).astype(object)
    return out.where(out.notna(), None)


def _rows(state: pd.DataFrame) -> list[dict]:
    """The changes of a run, as :func:`advance` takes them."""
    state = state.astype(object).where(state.notna(), None)
    return [dict(r, finds=[dict(x) for x in r["finds"]]) for r in state.to_dict("records") if r["kind"] == "change"]


def replay(units: DataFrame, rules: Rules = Rules(), until: int | None = None, finder=search) -> DataFrame:  # type: ignore[no-untyped-def]
    """Every daily run since a plan's first unit, on the units as they are now, to the midnight after the last one (or ``until``)."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        plan, told, previous, out = plan_of(f), {}, [], []
        for day in range(int(f["t"].min() // 24) + 1, (int(f["t"].max() // 24) + 1 if until is None else until) + 1):
            rows = run_day(Known(plan, 24.0 * day, told), day, previous, rules, True, finder)
            previous = [{k: _rounded(v) for k, v in r.items()} for r in rows if r["kind"] == "change"]
            out += rows
        return _frame(key[0], out)

    return dealt(units.select(*[x.split()[0] for x in UNITS.split(", ")]), "plan").groupBy("plan").applyInPandas(run, STATE)


def next_run(units: DataFrame, state: DataFrame, day: int, rules: Rules = Rules(), finder=search) -> DataFrame:  # type: ignore[no-untyped-def]
    """The rows of all plans' runs on ``day``, from the newest run of ``state`` before it."""
    last = state.filter(F.col("day") < day).agg(F.max("day")).first()[0]
    before = state.filter(F.col("day") == last) if last is not None else state.limit(0)

    def run(key: tuple, f: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _frame(key[0], run_day(plan_of(f), day, _rows(held), rules, False, finder))

    known = units.filter(F.col("t") < 24.0 * day).select(*[x.split()[0] for x in UNITS.split(", ")])
    return dealt(known, "plan").groupBy("plan").cogroup(dealt(before.select(*COLUMNS), "plan").groupBy("plan")).applyInPandas(run, STATE)


__all__ = ["Rules", "STATE", "UNITS", "advance", "next_run", "plan_of", "refine", "replay", "run_day", "search", "step_at"]
