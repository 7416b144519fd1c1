"""A new family's rate and the limit's change at its first use, by Huber's loss.

The meter's percent of a stretch is (known + rate x new) / (level x change), level being an account's own from its
stretches without the new family. The loss of a standardised log residual is square near the fit and linear far from it,
so weights depend on each stretch's own residual and cannot be summed beforehand. An account's stretches are
one row of arrays; levels of all draws are fitted there once, and each round is one pass that returns
five sums a draw: all draws take their steps together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.cut import written
from tidewater.stats.shares import LEAST_BEFORE, RATE_BOUNDS

#: Where the loss turns linear, in standard deviations.
HUBER_K = 1.345


def poisson_draws(keys: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) counts by draw (rows) and key: draw 0 is all ones; the others depend on key and draw alone."""
    x = keys.astype(np.uint64)[None] + np.arange(draws + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    cuts = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 8.0))]))
    out = np.searchsorted(cuts, u).astype(float)
    out[0] = 1.0
    return out


def location(x: np.ndarray, variance: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Huber location of values with counts, one a row of ``counts``; nan where a row is all zero."""
    with np.errstate(invalid="ignore"):
        at = (counts / variance * x).sum(1) / (counts / variance).sum(1)
        for _ in range(rounds):
            z = np.abs(x[None] - at[:, None]) / np.sqrt(variance)
            w = counts / variance * np.minimum(1.0, HUBER_K / np.maximum(z, 1e-300))
            new = (w * x).sum(1) / w.sum(1)
            moved = np.nanmax(np.abs(new - at), initial=0.0)
            at = new
            if moved < 1e-13:
                break
    return at


def scatter(rows: DataFrame, account: str, rate: float, variance: str) -> float:
    """The spread of log residuals about their account's median on each side, rounding taken out; 0 at least.

    Squared 1.4826 median deviations, less the mean rounding variance.
    """
    x = F.log((F.col("known") + F.lit(rate) * F.col("new")) / F.col("pct"))
    good = rows.filter("known + new > 0 and pct > 0").filter("side = 'after' or new = 0").select(account, "side", x.alias("x"), F.col(variance).alias("v"))
    mid = good.groupBy(account, "side").agg(F.median("x").alias("m"))
    r = good.join(mid, [account, "side"]).agg(F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"), F.avg("v").alias("v"), F.var_pop(F.col("x") - F.col("m")).alias("plain")).first()
    if r["mad"] is None:
        return 0.0
    return max((1.4826 * r["mad"]) ** 2 - r["v"], 0.0) or max((r["plain"] or 0.0) - r["v"], 0.0)


def _accounts(rows: DataFrame, account: str, block: str, variance: str, s2: float, draws: int, seed: int) -> DataFrame:
    """One row an account with a before side: its after stretches as arrays, and the level of each draw."""
    key = F.xxhash64(F.lit(seed), account, block).alias("k")
    x = F.log(F.col("known") / F.col("pct"))
    good = rows.filter("known + new > 0 and pct > 0").select(account, "side", "known", "new", "pct", (F.col(variance) + s2).alias("v"), key, x.alias("x"))
    struct = F.struct("known", "new", "pct", "v", "k", "x")
    each = good.groupBy(account).agg(F.collect_list(F.when((F.col("side") == "before") & (F.col("new") == 0), struct)).alias("before"), F.collect_list(F.when(F.col("side") == "after", struct)).alias("after"))
    each = each.filter((F.size("before") >= LEAST_BEFORE) & (F.size("after") > 0))

    def levels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for before, after in zip(f["before"], f["after"], strict=True):
                b = {c: np.array([r[c] for r in before], float if c != "k" else np.int64) for c in ("x", "v", "k")}
                level = location(b["x"], b["v"], poisson_draws(b["k"].view(np.uint64), draws))
                out.append({c: [r[c] for r in after] for c in ("known", "new", "pct", "v", "k")} | {"level": np.nan_to_num(level, nan=np.inf)})
            yield pd.DataFrame(out, columns=["known", "new", "pct", "v", "k", "level"])

    return each.select("before", "after").mapInPandas(levels, "known array<double>, new array<double>, pct array<double>, v array<double>, k array<bigint>, level array<double>")


def _sums(table: DataFrame, at: np.ndarray, draws: int) -> np.ndarray:
    """Sums of each draw at its (log rate, log change): rows, weighted 1, J, JJ, e, Je, and the loss."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws + 1, 7))
        for f in frames:
            for known, new, pct, v, k, level in f.itertuples(index=False):
                known, new, pct, v = (np.asarray(c, float)[None] for c in (known, new, pct, v))
                counts = poisson_draws(np.asarray(k, np.int64).view(np.uint64), draws)
                level = np.asarray(level, float)[:, None]
                counts = np.where(np.isfinite(level), counts, 0.0)
                part = np.exp(at[:, :1]) * new
                e = np.log((known + part) / pct) - np.where(np.isfinite(level), level, 0.0) - at[:, 1:]
                z, slope = np.abs(e) / np.sqrt(v), part / (known + part)
                w = counts / v * np.minimum(1.0, HUBER_K / np.maximum(z, 1e-300))
                loss = counts * np.where(z <= HUBER_K, z * z / 2, HUBER_K * (z - HUBER_K / 2))
                total += np.stack([counts.sum(1), w.sum(1), (w * slope).sum(1), (w * slope * slope).sum(1), (w * e).sum(1), (w * slope * e).sum(1), loss.sum(1)], axis=1)
        yield pd.DataFrame({"draw": np.arange(draws + 1), **{f"s{i}": total[:, i] for i in range(7)}})

    got = table.mapInPandas(run, "draw int, " + ", ".join(f"s{i} double" for i in range(7))).groupBy("draw").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(7))).collect()
    out = np.zeros((draws + 1, 7))
    for r in got:
        out[r["draw"]] = r[1:]
    return out


def joint_fit(rows: DataFrame, account: str, block: str, variance: str, start: tuple[float, float], s2: float, draws: int = 200, seed: int = 1, rounds: int = 60) -> DataFrame:
    """(draw, n, rate, log_change, spread) of each draw; draw 0 weighs every block once, the others by Poisson(1).

    ``rows`` is (account, block, side, pct, known, new) and the rounding variance of the log percent; ``start`` is a
    log rate and log change nearby, such as least squares gives. Steps are damped until the loss falls.
    """
    spark = rows.sparkSession
    table = written(_accounts(rows, account, block, variance, s2, draws, seed), "accounts")
    lo, hi = (float(np.log(b)) for b in RATE_BOUNDS)
    at = np.tile(np.array(start, float), (draws + 1, 1))
    trial, best, damp, kept = at.copy(), np.full(draws + 1, np.inf), np.full(draws + 1, 1e-6), np.zeros((draws + 1, 7))
    for _ in range(rounds):
        s = _sums(table, trial, draws)
        better = s[:, 6] <= best * (1 + 1e-14)
        at[better], kept[better] = trial[better], s[better]
        best = np.minimum(best, s[:, 6])
        damp = np.where(better, np.maximum(damp / 10, 1e-12), damp * 10)
        w, wj, wjj, we, wje = (kept[:, i] for i in range(1, 6))
        # e falls with the change and rises with the rate
        a, b, c = wjj * (1 + damp) + 1e-300, -wj, w * (1 + damp) + 1e-300
        det = np.maximum(a * c - b * b, 1e-300)
        step = np.stack([(-wje * c - we * b) / det, (a * we + b * wje) / det], axis=1)
        step = np.clip(step, -1, 1)
        trial = at + step
        trial[:, 0] = np.clip(trial[:, 0], lo, hi)
        if np.abs(trial - at)[kept[:, 0] > 0].max(initial=0.0) < 1e-11:
            break
    n, loss = kept[:, 0], best
    out = [(d, int(n[d]), float(np.exp(at[d, 0])), float(at[d, 1]), float((2 * loss[d] / max(n[d] - 1, 1)) ** 0.5)) for d in range(draws + 1) if n[d] > 0]
    return spark.createDataFrame(out, "draw int, n bigint, rate double, log_change double, spread double")


__all__: Sequence[str] = ["HUBER_K", "joint_fit", "location", "poisson_draws", "scatter"]
