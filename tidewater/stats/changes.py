"""Change-points: segmentation of one series, permutation scans over several accounts, and held states.

Series are one row a window, stretch or day of an account, so a group is small; scans over instants
and replicates are rows and spread over the cluster.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.cut import dealt

Split = tuple[int, int, int]


def segmented(n: int, least: int, gain: Callable[[int, int, int], float | None]) -> list[Split]:
    """Binary segmentation: the split with the largest gain, then both sides again; None rejects a split."""
    out: list[Split] = []
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        scored = [(g, -s) for s in range(lo + least, hi - least + 1) if (g := gain(lo, s, hi)) is not None]
        if scored:
            split = -max(scored)[1]
            out.append((lo, split, hi))
            todo += [(lo, split), (split, hi)]
    return sorted(out, key=lambda x: x[1])


def median_splits(values: np.ndarray, threshold: float, least: int) -> list[Split]:
    """Splits between persistent median levels that differ by more than a threshold."""
    loss = lambda x: float(np.abs(x - np.median(x)).sum())

    def gain(lo: int, s: int, hi: int) -> float | None:
        a, b = values[lo:s], values[s:hi]
        before = float(np.median(a))
        if not before or abs(np.median(b) / before - 1) <= threshold:
            return None
        return loss(values[lo:hi]) - loss(a) - loss(b)

    return segmented(len(values), least, gain)


@dataclass(frozen=True)
class ErrorModel:
    """What a pooled ratio may be off by, and the movement each side of a change needs."""

    dispersion: float = 3.7
    least_base: float = 20.0
    least_after: float = 20.0
    least_points: int = 2
    #: Points of error conceded to the numerator for one conceded to the denominator.
    numerator: float = 1.0


class PooledSeries:
    """Prefix sums of a series of (num, den, pieces)."""

    def __init__(self, num: np.ndarray, den: np.ndarray, pieces: np.ndarray, model: ErrorModel) -> None:
        self.num, self.den, self.model = num, den, model
        self.sums = np.concatenate([np.zeros((1, 3)), np.cumsum(np.column_stack([num, den, pieces]), axis=0)])

    def pool(self, a: int, b: int) -> tuple[float, float, float]:
        n, d, p = self.sums[b] - self.sums[a]
        return float(n), float(d), float(p)

    def level(self, a: int, b: int) -> float | None:
        n, d, _ = self.pool(a, b)
        return n / d if d > 0 else None

    def interval(self, a: int, b: int) -> tuple[float, float | None]:
        n, d, p = self.pool(a, b)
        e = 2 * (self.model.dispersion * p / 6) ** 0.5
        return max(0.0, n - self.model.numerator * e) / (d + e), (n + self.model.numerator * e) / (d - e) if d > e else None

    def change(self, a: int, s: int, b: int, threshold: float) -> float | None:
        """Change of level at s, if both sides carry enough and their intervals are apart."""
        m = self.model
        before, after = self.level(a, s), self.level(s, b)
        if min(s - a, b - s) < m.least_points or self.pool(a, s)[1] < m.least_base or self.pool(s, b)[1] < m.least_after or not before or not after:
            return None
        change = after / before - 1
        (blo, bhi), (alo, ahi) = self.interval(a, s), self.interval(s, b)
        apart = ahi is not None and ahi < blo if change < 0 else bhi is not None and alo > bhi
        return change if abs(change) > threshold and apart else None

    def loss(self, a: int, b: int) -> float:
        level = self.level(a, b)
        return float(np.abs(self.num[a:b] - (level or 0.0) * self.den[a:b]).sum())

    def splits(self, threshold: float) -> list[Split]:
        def gain(lo: int, s: int, hi: int) -> float | None:
            return None if self.change(lo, s, hi, threshold) is None else self.loss(lo, hi) - self.loss(lo, s) - self.loss(s, hi)

        return segmented(len(self.num), self.model.least_points, gain)


def smoothed_changes(df: DataFrame, by: Sequence[str], ts: str, value: str, threshold: float = 0.15, least: int = 4) -> DataFrame:
    """Steps of a noisy series, sized between the final segments next to them."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([ts, value], kind="stable")
        at, x = f[ts].to_numpy(), f[value].to_numpy(float)
        splits = median_splits(x, threshold, least)
        cuts = [0, *(s for _, s, _ in splits), len(x)]
        rows = [(*key, at[s], at[s - 1], at[min(hi - 1, s + least - 1)], float(np.median(x[s : cuts[i + 2]]) / np.median(x[cuts[i] : s]) - 1), hi - lo) for i, (lo, s, hi) in enumerate(splits)]
        return pd.DataFrame(rows, columns=[*by, "at", "before_at", "confirmed_at", "change", "points"])

    t = types[ts]
    return df.select(*by, ts, value).groupBy(*by).applyInPandas(run, ", ".join([*[f"{c} {types[c]}" for c in by], f"at {t}, before_at {t}, confirmed_at {t}, change double, points bigint"]))


def weighted_regimes(df: DataFrame, by: Sequence[str], ts: str, num: str = "d5", den: str = "d7", pieces: str = "pieces", threshold: float = 0.15, model: ErrorModel = ErrorModel()) -> DataFrame:
    """Regimes between certified changes of a pooled ratio: span, level, interval, and the change that opened it."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f[(f[num] >= 0) & (f[den] >= 0) & ((f[num] > 0) | (f[den] > 0))].sort_values([ts, num, den], kind="stable")
        series = PooledSeries(f[num].to_numpy(float), f[den].to_numpy(float), f[pieces].to_numpy(float), model)
        splits = series.splits(threshold)
        found = {s: (lo, hi) for lo, s, hi in splits}
        cuts, at, rows = [0, *sorted(found), len(f)], f[ts].to_numpy(), []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            level = series.level(a, b)
            if a == b or level is None:
                continue
            lo, hi = series.interval(a, b)
            change = confirmed = None
            if a in found:
                before = series.level(cuts[i - 1], a)
                change = level / before - 1 if before else None
                start, stop = found[a]
                confirmed = next((at[j - 1] for j in range(a + model.least_points, stop + 1) if series.change(start, a, j, threshold) is not None), None)
            rows.append((*key, i, at[a], at[b - 1], level, lo, hi, b - a, change, confirmed))
        return pd.DataFrame(rows, columns=[*by, "regime", "start", "end", "level", "lo", "hi", "points", "change", "confirmed_at"])

    t = types[ts]
    return df.select(*by, ts, num, den, pieces).groupBy(*by).applyInPandas(run, ", ".join([*[f"{c} {types[c]}" for c in by], f"regime bigint, start {t}, end {t}, level double, lo double, hi double, points bigint, change double, confirmed_at {t}"]))


# --- permutation scan over accounts ------------------------------------------------------------------


def studentized(num: np.ndarray, den: np.ndarray, after: np.ndarray, prior: float, prior_units: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Log step and its variance for rows of a boolean matrix: which units lie after."""
    level = num.sum() / den.sum()
    off = num - level * den
    columns = np.column_stack([num, den, off, off**2 / np.maximum(den, 1e-300), np.ones(len(num))])
    out = []
    for m in (after, ~after):
        n, d, o, squares, k = (m.astype(float) @ columns).T
        ratio = n / np.maximum(d, 1e-300)
        # what is left around a side's own ratio is what lies around the common level less the step between the two
        squares = np.maximum(squares - o**2 / np.maximum(d, 1e-300), 0.0)
        noise = (squares + prior_units * prior) / np.maximum(k - 1 + prior_units, 1)
        out.append((np.log(np.maximum(ratio, 1e-12) / level), noise / np.maximum(d, 1e-300) / np.maximum(ratio, 1e-12) ** 2))
    (a, va), (b, vb) = out
    return a - b, va + vb


#: Shuffles of one stream: shuffle k is row k % BLOCK of stream k // BLOCK, whichever round asks for it.
BLOCK = 500


def account_step(t: np.ndarray, num: np.ndarray, den: np.ndarray, tau: float, cuts: Sequence[float], unit_hours: float = 24.0, side_days: int = 14, least_units: int = 2) -> tuple[float, float, tuple] | None:
    """One account's log step at an instant, its variance, and what its shuffles need; None where a side is too short."""
    lo = max([tau - 24 * side_days, *(b for b in cuts if b < tau)])
    hi = min([tau + 24 * side_days, *(b for b in cuts if b > tau)])
    near = (t >= lo) & (t < hi)
    keys, where = np.unique(np.floor((t[near] - tau) / unit_hours), return_inverse=True)
    w, d = np.bincount(where, num[near]), np.bincount(where, den[near])
    good = d > 0
    w, d, side = w[good], d[good], keys[good] >= 0
    if side.sum() < least_units or (~side).sum() < least_units or w.sum() <= 0:
        return None
    prior = float(((w - w.sum() / d.sum() * d) ** 2 / d).mean())
    step, variance = studentized(w, d, side[None], prior)
    return float(step[0]), float(variance[0]), (w, d, side, prior)


def account_steps(t: np.ndarray, num: np.ndarray, den: np.ndarray, taus: Sequence[float], cuts: Sequence[float], unit_hours: float = 24.0, side_days: int = 14, least_units: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`account_step` at many instants at once, without shuffles: which have a step, the steps and their variances."""
    at = np.asarray(taus, float)[:, None]
    lo, hi = at - 24 * side_days, at + 24 * side_days
    for b in cuts:
        lo, hi = np.where(b < at, np.maximum(lo, b), lo), np.where(b > at, np.minimum(hi, b), hi)
    keys = np.floor((t - at) / unit_hours)
    good = (t >= lo) & (t < hi) & (den > 0)
    total = lambda x, m: np.where(m, x, 0.0).sum(1, keepdims=True)
    squares = lambda ratio, m: total((num - ratio * den) ** 2 / np.maximum(den, 1e-300), m)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        level = total(num, good) / total(den, good)
        prior = squares(level, good) / good.sum(1, keepdims=True)
        sides = []
        for m in (good & (keys >= 0), good & (keys < 0)):
            k, d = m.sum(1, keepdims=True), np.maximum(total(den, m), 1e-300)
            ratio = total(num, m) / d
            low = np.maximum(ratio, 1e-12)
            sides.append((k >= least_units, np.log(low / level), (squares(ratio, m) + 4 * prior) / (k + 3) / d / low**2))
        (some, after, va), (others, before, vb) = sides
        told, step, variance = (x[:, 0] for x in (some & others & ~(level <= 0), after - before, va + vb))
    for i in np.flatnonzero((np.diff(keys, axis=1) <= 0).any(1)):  # several rows make a unit
        found = account_step(t, num, den, float(at[i, 0]), cuts, unit_hours, side_days, least_units)
        told[i] = found is not None
        step[i], variance[i] = found[:2] if found else (0.0, 1.0)
    return told, step, variance


def shuffled(units: tuple, tau: float, name: object, seed: int, skip: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted step and weight of the shuffles ``skip`` to ``skip + count``: they depend on seed, instant, account and their own number only."""
    w, d, side, prior = units
    top, bottom = [np.zeros(0)], [np.zeros(0)]
    for block in range(skip // BLOCK, -(-(skip + count) // BLOCK)):
        rng = np.random.Generator(np.random.PCG64([seed, int(round(tau * 4)) & 0xFFFFFFFF, zlib.crc32(str(name).encode()), block]))
        sides = rng.permuted(np.broadcast_to(side.astype(np.int64), (BLOCK, len(side))), axis=1).astype(bool)  # words move faster than bytes
        part = slice(max(0, skip - block * BLOCK), skip + count - block * BLOCK)
        s, v = studentized(w, d, sides, prior)
        top.append((s / v)[part])
        bottom.append((1 / v)[part])
    return np.concatenate(top), np.concatenate(bottom)


def votes(units: DataFrame, taus: Sequence[float], unit_hours: float = 24.0, side_days: int = 14, permutations: int = 2000, seed: int = 7, least_units: int = 2, breaks: Sequence[float] = (), skip: int = 0) -> DataFrame:
    """Each account's step at each instant, and rows without an account that hold a task's sums of shuffles.

    ``breaks`` are known changes: an instant's sides end at the nearest of them on either hand. Shuffles
    before ``skip`` were done in an earlier round.
    """
    grid = sorted({float(t) for t in taus})
    cuts = [float(b) for b in breaks]
    columns = ["tau", "account", "step", "variance", "top", "bottom"]

    def run(frames):  # type: ignore[no-untyped-def]
        sums: dict[float, list[np.ndarray]] = {}
        for name, frame in whole_accounts(frames):
            rows = []
            t, num, den = (frame[c].to_numpy(float) for c in ("t", "num", "den"))
            if not permutations:
                steps = zip(grid, *account_steps(t, num, den, grid, cuts, unit_hours, side_days, least_units), strict=True)
                rows = [(tau, str(name), s, v, None, None) for tau, told, s, v in steps if told]
            for tau in grid if permutations else ():
                if found := account_step(t, num, den, tau, cuts, unit_hours, side_days, least_units):
                    rows.append((tau, str(name), *found[:2], None, None))
                    held = sums.setdefault(tau, [np.zeros(permutations), np.zeros(permutations)])
                    top, bottom = shuffled(found[2], tau, name, seed, skip, permutations)
                    held[0] += top
                    held[1] += bottom
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([(tau, None, None, None, *x) for tau, x in sums.items()], columns=columns)

    rows = dealt(units.select("account", "t", "num", "den"), "account", few=True).sortWithinPartitions("account", "t")
    return rows.mapInPandas(run, "tau double, account string, step double, variance double, top array<double>, bottom array<double>")


def _marked(told: DataFrame) -> DataFrame:
    """The shared step of each instant that :func:`votes` tells of, and whether its accounts agree."""
    voted = told.filter("account is not null")
    weight, x = 1 / F.col("variance"), F.col("step")
    totals = voted.groupBy("tau").agg(F.sum(weight).alias("w"), F.sum(weight * x).alias("wx"), F.count("*").alias("voting"))
    totals = totals.withColumns({"mean": F.col("wx") / F.col("w"), "z": F.col("wx") / F.sqrt("w")})
    se = F.sqrt("variance")
    others = (F.col("wx") - weight * x) / F.sqrt(F.greatest(F.col("w") - weight, F.lit(1e-300)))
    marks = voted.join(totals, "tau").groupBy("tau").agg(
        F.bool_and(F.abs(x - F.col("mean")) <= 2.5 * se).alias("near"), F.bool_or((F.signum(x) != F.signum("mean")) & (F.abs(x) > 1.96 * se)).alias("opposed"), F.min(F.signum("z") * others).alias("without_one"),
    )
    several = F.col("voting") >= 2
    return totals.join(marks, "tau").select("tau", "mean", "z", "w", "voting", (several & F.col("near") & ~F.col("opposed")).alias("agree"), (several & (F.col("without_one") >= 1.96)).alias("plan_wide"))


def _scanned(told: DataFrame) -> DataFrame:
    """What :func:`votes` tells of each instant; ``as_far`` counts the shuffles that go at least as far as the step itself."""
    marked = _marked(told)
    drawn = told.filter("account is null").select("tau", F.posexplode(F.arrays_zip("top", "bottom")).alias("draw", "d"))
    drawn = drawn.groupBy("tau", "draw").agg(F.sum("d.top").alias("top"), F.sum("d.bottom").alias("bottom")).join(marked.select("tau", "z"), "tau")
    far = F.abs(F.col("top") / F.sqrt("bottom")) >= F.abs("z") * (1 - 1e-12)
    far = drawn.groupBy("tau").agg(F.count_if(far).alias("as_far"))
    return marked.join(far, "tau").select("tau", F.round("mean", 9).alias("step"), F.round("z", 9).alias("z"), "as_far", "voting", "agree", "plan_wide", F.round(1 / F.sqrt("w"), 9).alias("se"))


def scan(units: DataFrame, taus: Sequence[float], unit_hours: float = 24.0, side_days: int = 14, permutations: int = 2000, seed: int = 7, least_units: int = 2, breaks: Sequence[float] = ()) -> DataFrame:
    """For each candidate instant: the step all accounts share, its z, a permutation p, and whether they agree.

    ``units`` is (account, t, num, den) with t in hours: a few numbers a day, so one account is a small group.
    Accounts are dealt over tasks; a task adds its accounts' shuffles up and sends one row an instant, and
    the rest is sums, rounded to nine places. Shuffles are seeded by instant, account and number, wherever they run.
    """
    told = votes(units, taus, unit_hours, side_days, permutations, seed, least_units, breaks).persist()
    return _scanned(told).select("tau", "step", "z", ((1 + F.col("as_far")) / (permutations + 1)).alias("p"), "voting", "agree", "plan_wide", "se")


def rounds(permutations: int, most: int) -> Iterator[tuple[int, int]]:
    """(done before, done after) of each round: four times as many as before, up to ``most``."""
    done = 0
    while done < most:
        then = min(max(permutations, 4 * done), most)
        yield done, then
        done = then


def undecided(as_far: int, done: int, alpha: float, errors: float) -> bool:
    """Is p within so many Monte Carlo standard errors of ``alpha``; a step that no shuffle reached is clear at once."""
    return as_far > 0 and abs((1 + as_far) / (done + 1) - alpha) < errors * (alpha * (1 - alpha) / done) ** 0.5


def whole_accounts(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
    """(account, its rows) from batches sorted by account."""
    held: pd.DataFrame | None = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        if len(held):
            last = held["account"].iloc[-1]
            yield from held[held["account"] != last].groupby("account")
            held = held[held["account"] == last]
    if held is not None and len(held):
        yield held["account"].iloc[0], held


def refined(units: DataFrame, permutations: int = 2000, around_hours: int = 48, passes: int = 3) -> DataFrame:
    """The strongest instant of a daily grid, then of an hourly one around it, until it stays; with the range of instants whose |z| is within 1 of its own."""
    lo, hi = units.agg(F.min("t"), F.max("t")).first()
    grid = [] if lo is None else [lo + 48 + 24 * i for i in range(max(0, int((hi - lo - 96) / 24)))]
    best, found = None, scan(units, grid, permutations=permutations)
    for _ in range(passes):
        top = strongest(found, permutations).first()
        if top is None or top.tau == best:
            break
        best = top.tau
        found = scan(units, [best + h for h in range(-around_hours, around_hours + 1)], permutations=permutations)
    top = strongest(found, permutations)
    wide = found.crossJoin(F.broadcast(top.select(F.abs("z").alias("_z")))).filter(F.abs("z") >= F.col("_z") - 1).agg(F.min("tau").alias("first_tau"), F.max("tau").alias("last_tau"))
    return top.crossJoin(F.broadcast(wide))


# --- greedy search: rows of the driver are one an instant of the grid -----------------------------------


def clear_scan(units: DataFrame, taus: Sequence[float], permutations: int = 2000, most: int = 100_000, alpha: float = 0.001, errors: float = 3.0, unit_hours: float = 24.0, side_days: int = 14, seed: int = 7, least_units: int = 2, breaks: Sequence[float] = ()) -> dict[float, dict]:
    """:func:`scan` by instant, shuffled on where p is too near ``alpha``, until it is told apart or ``most`` are done.

    A round adds its shuffles to those before: the count after 2,000 and 6,000 is that of 8,000 at once.
    """
    out: dict[float, dict] = {}
    todo = sorted({float(t) for t in taus})
    for before, done in rounds(permutations, most):
        told = votes(units, todo, unit_hours, side_days, done - before, seed, least_units, breaks, before).persist()
        try:
            for r in _scanned(told).collect():
                far = r["as_far"] + (out[r["tau"]]["as_far"] if before else 0)
                out[r["tau"]] = r.asDict() | {"as_far": far, "permutations": done, "p": (1 + far) / (done + 1)}
        finally:
            told.unpersist()
        todo = [t for t in todo if t in out and undecided(out[t]["as_far"], done, alpha, errors)]
        if not todo:
            break
    return out


def is_flagged(row: dict, alpha: float) -> bool:
    return bool(row["p"] < alpha and row["agree"] and row["plan_wide"] and row["voting"] >= 2)


def agreeing(units: DataFrame, taus: Sequence[float], side_days: int = 14, breaks: Sequence[float] = ()) -> dict[float, float]:
    """|z| of the instants whose accounts agree: no p flags another."""
    told = votes(units, taus, side_days=side_days, permutations=0, breaks=breaks).persist()
    try:
        return {r.tau: r.z for r in _marked(told).filter("agree and plan_wide").select("tau", F.round(F.abs("z"), 9).alias("z")).collect()}
    finally:
        told.unpersist()


def search(units: DataFrame, taus: Sequence[float], permutations: int = 2000, alpha: float = 0.001, breaks: Sequence[float] = (), gap_hours: float = 48.0, side_days: int = 14, most_changes: int = 12, most: int = 100_000) -> list[dict]:
    """The flagged instant of the smallest p becomes a change, cuts its neighbours' sides, and what it cut is scanned again, until none flags.

    ``breaks`` are changes known before: they cut from the start and are not found again. Ties go to the
    larger |z|; p is compared at the first round's resolution. So instants are shuffled by falling |z|, until
    one has the least p: no later one comes before it.
    """
    cuts, out = [float(b) for b in breaks], []
    grid = sorted({float(t) for t in taus})
    rows: dict[float, dict] = {}
    strength: dict[float, float] = {}
    stale, least = grid, 1 / (permutations + 1)
    while stale and len(out) < most_changes:
        strength |= agreeing(units, stale, side_days, cuts)
        todo = sorted((t for t in strength if all(abs(t - c) >= gap_hours for c in cuts)), key=lambda t: (-strength[t], t))
        open_: list[dict] = []
        size = 1
        while todo and not any(r["p"] <= least for r in open_):
            part, todo = todo[:size], todo[size:]
            if fresh := [t for t in part if t not in rows]:
                rows |= clear_scan(units, fresh, permutations, most, alpha, side_days=side_days, breaks=cuts)
            open_ += [rows[t] for t in part if t in rows and is_flagged(rows[t], alpha)]
            size *= 4
        if not open_:
            break
        best = min(open_, key=lambda r: (max(r["p"], least), -abs(r["z"]), r["tau"]))
        out.append(best)
        cuts.append(best["tau"])
        stale = [t for t in grid if abs(t - best["tau"]) <= 24 * side_days]
        for t in stale:
            rows.pop(t, None)
            strength.pop(t, None)
    return out


def found_again(units: DataFrame, taus: Sequence[float], at: float, sign: int, span: tuple[float, float], breaks: Sequence[float], alpha: float = 0.001, gap_hours: float = 48.0, **options) -> dict:  # type: ignore[no-untyped-def]
    """Would today's search find a carried change: a flagged instant of its sign in its range, the sides cut at every other change.

    p and z are those of the strongest such instant, of the nearest one where none flags, and None where the grid has none.
    """
    others = [b for b in breaks if b != at]
    near = [t for t in taus if span[0] - gap_hours <= t <= span[1] + gap_hours and all(abs(t - at) <= abs(t - b) for b in others)]
    rows = clear_scan(units, near, alpha=alpha, breaks=others, **options)
    hits = [r for r in rows.values() if is_flagged(r, alpha) and (1 if r["step"] > 0 else -1) == sign]
    told = min(hits, key=lambda r: (r["p"], -abs(r["z"]))) if hits else min(rows.values(), key=lambda r: abs(r["tau"] - at), default=None)
    return {"at": at, "found_today": bool(hits), "p": told and told["p"], "z": told and told["z"]}


def sizes(units: DataFrame, taus: Sequence[float], factor: float = 1.0, side_days: int = 14) -> DataFrame:
    """Each change's shared step with an interval widened by ``factor``, each account's own, and the step without that account.

    One row a change and account; sides end at the neighbouring changes.
    """
    v = votes(units, taus, side_days=side_days, permutations=0, breaks=taus).filter("account is not null").select("tau", "account", "step", "variance")
    weight = 1 / F.col("variance")
    totals = v.groupBy("tau").agg(F.sum(weight).alias("_w"), F.sum(weight * F.col("step")).alias("_wx"))
    pct = lambda e: F.round(100 * (F.exp(e) - 1), 6)
    half, own, rest = 1.96 * factor / F.sqrt("_w"), 1.96 * factor * F.sqrt("variance"), F.col("_w") - weight
    mean, others = F.col("_wx") / F.col("_w"), F.when(rest > 1e-12 * F.col("_w"), (F.col("_wx") - weight * F.col("step")) / rest)
    return v.join(totals, "tau").select(
        "tau", "account", pct(mean).alias("change_pct"), pct(mean - half).alias("lo"), pct(mean + half).alias("hi"), pct(F.col("step")).alias("own_pct"), pct(F.col("step") - own).alias("own_lo"), pct(F.col("step") + own).alias("own_hi"), pct(others).alias("without_pct"), F.round(others * F.sqrt(rest), 6).alias("without_z"),
    )


def medians_apart(before: np.ndarray, after: np.ndarray, widths: float = 2.0) -> np.ndarray:
    """Is the step between two medians more than so many standard errors of them; of matrices, row by row."""
    middle = lambda x: np.median(x, axis=-1, keepdims=True)
    se = lambda x: 1.253 * 1.4826 * middle(np.abs(x - middle(x))) / x.shape[-1] ** 0.5
    return (np.abs(middle(after) - middle(before)) > widths * (se(before) ** 2 + se(after) ** 2) ** 0.5)[..., 0]


def flagged(scanned: DataFrame, alpha: float = 0.001) -> DataFrame:
    return scanned.filter((F.col("p") < alpha) & F.col("agree") & F.col("plan_wide") & (F.col("voting") >= 2))


def strongest(scanned: DataFrame, permutations: int) -> DataFrame:
    """The instant with the smallest p, ties by |z|."""
    return scanned.orderBy(F.greatest("p", F.lit(1 / (permutations + 1))), -F.abs("z"), "tau").limit(1)


def episodes(hits: DataFrame, by: Sequence[str], at: str, gap: float, best: str) -> DataFrame:
    """Hits within a gap of each other are one episode, told by the row that is least by ``best``."""
    from tidewater.operators.ordered import segment_ids
    from pyspark.sql.window import Window as W

    far = F.col(at) - F.lag(at).over(W.partitionBy(*by).orderBy(at)) > gap
    marked = segment_ids(hits.withColumn("_far", F.coalesce(far, F.lit(False))), by, [at], F.col("_far"), "episode")
    rows = F.struct(*[F.col(c) for c in hits.columns if c not in by])
    out = marked.withColumn("_row", rows).groupBy(*by, "episode").agg(F.min_by("_row", F.struct(best, at)).alias("_row"), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("hits"))
    return out.select(*by, "episode", "first", "last", "hits", "_row.*")


# --- held changes -------------------------------------------------------------------------------------


def held_states(finds: DataFrame, by: Sequence[str] = ("line", "sign"), match_hours: float = 168.0, days: int = 7, withdrawn: bool = False) -> DataFrame:
    """Each day's finds carried on: candidate on the first day, provisional after, measured after ``days`` in a row.

    ``finds`` is (line, sign, day, at) with at in hours. A find continues the nearest one of the day before
    within ``match_hours``, each taken once; a day without it starts over, unless it is measured by then.
    With ``withdrawn`` the day that an unmeasured find is gone tells it in that state.
    """
    from tidewater.operators.ordered import fold

    def make():  # type: ignore[no-untyped-def]
        state: dict = {"day": None, "today": [], "held": []}

        def told_gone(gone: list[dict], day: int) -> list[tuple]:
            return [(day, h["at"], h["first"], h["n"], "withdrawn", False) for h in gone if withdrawn]

        def close() -> list[tuple]:
            pairs = sorted((abs(a - h["at"]), i, j) for i, a in enumerate(state["today"]) for j, h in enumerate(state["held"]) if abs(a - h["at"]) <= match_hours)
            taken: dict[int, int] = {}
            for _, i, j in pairs:
                if i not in taken and j not in taken.values():
                    taken[i] = j
            new = []
            for i, at in enumerate(state["today"]):
                old = state["held"][taken[i]] if i in taken else None
                new.append({"at": at, "first": old["first"] if old else state["day"], "n": old["n"] + 1 if old else 1, "measured": bool(old and old["measured"])})
            left = [h for j, h in enumerate(state["held"]) if j not in taken.values()]
            carried, gone = [h for h in left if h["measured"]], [h for h in left if not h["measured"]]
            for h in new:
                h["measured"] |= h["n"] >= days
            state["held"] = new + carried
            told = [(state["day"], h["at"], h["first"], h["n"], "measured" if h["measured"] else "provisional" if h["n"] > 1 else "candidate", h in new) for h in state["held"]]
            return told + told_gone(gone, state["day"])

        def step(row: tuple) -> list[tuple]:
            day, at = row
            out = []
            if state["day"] is not None and day != state["day"]:
                out = close()
                if day > state["day"] + 1:
                    out += told_gone([h for h in state["held"] if not h["measured"]], state["day"] + 1)
                    state["held"] = [h for h in state["held"] if h["measured"]]
                state["today"] = []
            state["day"] = day
            state["today"].append(at)
            return out

        return step, lambda: close() if state["day"] is not None else []

    types = {f.name: f.dataType.simpleString() for f in finds.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "day bigint, at double, first_found bigint, held_days bigint, state string, found_today boolean"])
    return fold(finds.select(*by, "day", "at"), by, ["day", "at"], make, schema)


def power(before: np.ndarray, step: float, after: int, trials: int, seed: int, spark, test: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:  # type: ignore[no-untyped-def]
    """Share of seeded simulations in which a test finds a step of a given size; trials are rows."""
    shared = spark.sparkContext.broadcast(np.asarray(before, float))

    def run(frames):  # type: ignore[no-untyped-def]
        for f in frames:
            hits = []
            for i in f["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(i)]))
                x = rng.choice(shared.value, len(shared.value))
                hits.append(bool(test(x, rng.choice(shared.value, after) * step)))
            yield pd.DataFrame({"hit": hits})

    return spark.range(trials).mapInPandas(run, "hit boolean").agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count("*").alias("trials"))


@lru_cache(maxsize=16)
def drawn_places(seed: int, first: int, last: int, n: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that each trial draws from n values: n of them, then ``after`` more; the same for every key of n values."""
    out = []
    for i in range(first, last):
        rng = np.random.Generator(np.random.PCG64([seed, i]))
        out.append((rng.choice(n, n), rng.choice(n, after)))
    return np.array([x for x, _ in out]), np.array([y for _, y in out])


def power_by(df: DataFrame, by: str, value: str, step: float, after: int, trials: int, seed: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 500) -> DataFrame:
    """:func:`power` for each key's own values; a key's trials are dealt over tasks in blocks, and ``test`` takes a trial a row."""
    kind = df.schema[by].dataType.simpleString()
    blocks = df.sparkSession.range(-(-trials // block)).withColumnRenamed("id", "_block")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        before = np.sort(f["_x"].to_numpy(float))
        first, last = key[1] * block, min((key[1] + 1) * block, trials)
        x, y = drawn_places(seed, first, last, len(before), after)
        return pd.DataFrame({by: [key[0]], "hits": [int(test(before[x], before[y] * step).sum())], "n": [last - first]})

    drawn = dealt(df.select(by, F.col(value).cast("double").alias("_x")).crossJoin(F.broadcast(blocks)), by, "_block").groupBy(by, "_block").applyInPandas(run, f"{by} {kind}, hits long, n long")
    return drawn.groupBy(by).agg((F.sum("hits") / F.sum("n")).alias("rate"), F.sum("n").alias("trials"))


def state_document(rows: Sequence[dict]) -> str:
    """A run's held states as a JSON document with sorted keys."""
    return json.dumps({"changes": list(rows)}, sort_keys=True)
