"""Regimes told by clusters against a plain walk, and the rounding programme against all vertices."""

import itertools
import random
from statistics import median

import numpy as np
import pandas as pd
import pytest

from tidewater.stats import feasible, regimes


def figure(values, factor):
    return [f(v) * factor for f in (median, min, max) for v in [values]]


def cluster(readings):
    """(family, n, measured, in the anchor's units) of the family with the most readings."""
    by = {}
    for fam, v in readings:
        by.setdefault(fam, []).append(v)
    if not by:
        return None
    fam = min(by, key=lambda f: (-len(by[f]), f))
    return fam, len(by[fam]), figure(by[fam], 1.0), figure(by[fam], {"a": 1.0, "b": 2.0, "c": 0.5}[fam])


def walk(changes, readings, least, anchor="a"):
    """One key's regimes, one after the other. changes: (at, ratio, lo, hi, scaled); readings: (start, family, value)."""
    changes = sorted(changes)
    spans = [[(f, v) for s, f, v in readings if (k == 0 or s >= changes[k - 1][0]) and (k == len(changes) or s < changes[k][0])] for k in range(len(changes) + 1)]
    runs = [[0]]
    for k, c in enumerate(changes, 1):
        runs.append([k]) if c[4] else runs[-1].append(k)
    of_run = {}
    for run in runs:
        own = cluster([x for k in run for x in spans[k]])
        if len(run) > 1 and own and own[1] >= least:
            of_run |= {k: (run[0], own) for k in run}
    out = []
    for k in range(len(changes) + 1):
        prev, c = (out[-1], changes[k - 1]) if k else (None, None)
        known = prev is not None and prev["value"] is not None
        own, scaled = cluster(spans[k]), bool(k and c[4])
        first, told = of_run.get(k, (k, own))
        rate, source = None, None
        if k in of_run and k > first:
            value, fam, measured, source = [prev["value"], prev["lo"], prev["hi"]], told[0], told[2], "run_cluster"
        elif k in of_run or own and (own[1] >= least or not known):
            fam, _, measured, value = told
            source = "run_cluster" if k in of_run else "cluster"
            if known and scaled and fam != anchor:
                rate = prev["value"] * c[1] / measured[0]
                value = [m * rate for m in measured]
        elif scaled:
            source, fam = "scaled", prev["measured_family"]
            value = [prev[x] and prev[x] * m for x, m in zip(("value", "lo", "hi"), c[1:4], strict=True)]
            measured = [prev[x] and prev[x] * m for x, m in zip(("measured_value", "measured_lo", "measured_hi"), c[1:4], strict=True)]
        else:
            source, fam = "carried", prev["measured_family"] if prev else None
            value = [prev[x] if prev else None for x in ("value", "lo", "hi")]
            measured = [prev[x] if prev else None for x in ("measured_value", "measured_lo", "measured_hi")]
        n = told[1] if k in of_run else own[1] if own else 0
        out.append({"regime": k, "source": source, **dict(zip(("value", "lo", "hi"), value, strict=True)), "measured_family": fam, **dict(zip(("measured_value", "measured_lo", "measured_hi"), measured, strict=True)), "n_regime_family": n, "bridge_rate": rate})
    return out


def same(a, b):
    return a == b if a is None or b is None or isinstance(a, (str, int)) else abs(a - b) <= 1e-9 * abs(b)


def test_regimes_equal_a_plain_walk(spark):
    r, changes, readings = random.Random(6), [], []
    for key in range(30):
        cuts = sorted(r.sample(range(10, 100), r.randrange(1, 8)))
        changes += [(key, at, ratio := r.uniform(0.5, 2), ratio * 0.9, ratio * 1.1, r.random() < 0.6) for at in cuts]
        readings += [(key, r.choice([*range(110), *cuts]), r.choice("aabbc"), r.uniform(1, 9)) for _ in range(r.choice([0, 3, 12, 40]))]
    c = spark.createDataFrame([(k, at, *rest) for k, at, *rest in changes], "key int, at bigint, ratio double, lo double, hi double, scaled boolean")
    factor = {"a": 1.0, "b": 2.0, "c": 0.5}
    d = spark.createDataFrame([(k, s, f, v, v * factor[f]) for k, s, f, v in readings] + [(99, 5, "a", 1.0, 1.0)], "key int, start bigint, family string, value double, anchor_value double")
    got = {(x.key, x.regime): x for x in regimes.cluster_regimes(c, d, ["key"], "a", least=5).collect()}
    seen = set()
    for key in range(30):
        want = walk([x[1:] for x in changes if x[0] == key], [x[1:] for x in readings if x[0] == key], 5)
        for w in want:
            g = got.pop((key, w["regime"]))
            seen.add((w["source"], w["bridge_rate"] is not None))
            assert all(same(g[k], v) for k, v in w.items()), (key, w, g)
    assert not got and {("run_cluster", False), ("run_cluster", True), ("cluster", False), ("cluster", True), ("scaled", False), ("carried", False)} <= seen


def vertices(x, y, slack):
    """The least t over all points where as many bounds meet as there are unknowns."""
    n, m = x.shape
    a = np.vstack([np.column_stack([x, -np.ones(n)]), np.column_stack([-x, -np.ones(n)]), -np.eye(m + 1)])
    b = np.concatenate([y + slack, slack - y, np.zeros(m + 1)])
    best = np.inf
    for at in itertools.combinations(range(len(a)), m + 1):
        try:
            z = np.linalg.solve(a[list(at)], b[list(at)])
        except np.linalg.LinAlgError:
            continue
        if (a @ z <= b + 1e-7).all():
            best = min(best, z[-1])
    return best


@pytest.mark.parametrize("m", [1, 2, 3])
def test_least_slack_equals_every_vertex(m):
    rng = np.random.default_rng(m)
    for turn in range(25):
        n = int(rng.integers(1, 7 if m == 3 else 9))
        x = rng.integers(0, 5, (n, m)) * rng.choice([1.0, 1e5], m)
        y, slack = rng.integers(0, 12, n).astype(float), rng.integers(0, 3, n).astype(float)
        if turn % 5 == 0:
            y = x @ rng.random(m) + rng.uniform(-1, 1, n) * slack
        t, b = feasible.least_slack(x, y, slack)
        assert abs(t - max(vertices(x / np.maximum(x.max(0), 1), y, slack), 0)) < 1e-6
        assert (b >= 0).all() and feasible.excess(x, y, slack, b).max() <= t + 1e-6


def test_groups_of_many_parts_equal_one_fit(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(4):
        x = rng.integers(0, 1000, (400, 3)).astype(float)
        y = np.round(x @ [0.01, 0.02, 0.005]) + (rng.integers(-9, 10, 400) if g % 2 else 0)
        rows.append(pd.DataFrame({"g": g, "y": y, "s": 1.0, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    df = spark.createDataFrame(pd.concat([*rows, pd.DataFrame({"g": [9, 9], "y": [None, 3.0], "s": [1.0, 1.0], "a": [1.0, None], "b": [0.0, 0.0], "c": [0.0, 0.0]})]))
    df = df.withColumns({c: df[c].cast("double") for c in "ysabc"}).replace(float("nan"), None)
    out = {r.g: r for r in feasible.rounding_slack(df, ["g"], "y", "s", ["a", "b", "c"], part_rows=60).collect()}
    for g, f in enumerate(rows):
        t, _ = feasible.least_slack(f[["a", "b", "c"]].to_numpy(), f["y"].to_numpy(), f["s"].to_numpy())
        assert abs(out[g].extra - t) < 1e-6 and out[g].n == 400
    assert out[0].extra == 0 and out[1].extra > 3
    assert out[9].n == 1 and abs(out[9].extra - 2.0) < 1e-9
