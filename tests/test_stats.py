"""Fits and change-points against brute force and planted truth."""

import numpy as np
import pandas as pd

from tidewater.stats import changes, fits


def test_two_variable_ls(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(50), rng.random(50)
    y = 2 * a + 3 * b
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "a": a, "b": b, "y": y}))
    r = fits.two_variable_ls(df, ["g"], "y", "a", "b").first()
    assert abs(r.ka - 2) < 1e-9 and abs(r.weight - 1.5) < 1e-9


def test_nnls_is_the_best_nonnegative(spark):
    rng = np.random.default_rng(2)
    x = rng.random((40, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.01 * rng.standard_normal(40)
    b = fits.nnls(x, y)
    assert (b >= 0).all() and b[1] == 0
    loss = lambda v: ((y - x @ v) ** 2).sum()
    assert all(loss(b) <= loss(np.maximum(b + 0.01 * rng.standard_normal(3), 0)) + 1e-12 for _ in range(200))


def test_irls_recovers_the_factor():
    rng = np.random.default_rng(3)
    share = rng.random(2000)
    y = rng.poisson(np.exp(2 + 0.5 * share)).astype(float)
    b, se, phi = fits.irls_poisson(y, np.column_stack([np.ones(2000), share]))
    assert abs(b[1] - 0.5) < 4 * se[1] and 0.8 < phi < 1.2


def test_huber_resists_an_outlier():
    at, w = fits.huber(np.array([1.0, 1.1, 0.9, 50.0]), np.full(4, 0.01))
    assert 0.8 < at < 1.4 and w[3] < 0.05


def test_minimisers():
    assert abs(fits.best_on_grid(lambda z: (z - 0.3) ** 2, -1, 1) - 0.3) < 1e-6


def test_log_offsets_equal_dense_least_squares_in_no_single_group(spark):
    rng = np.random.default_rng(8)
    rows = [(u, e, float(rng.uniform(1, 9)), float(rng.uniform(1, 5))) for u in range(12) for e in range(3) if (u + e) % 4 for _ in range(2)]
    out = fits.log_offsets(spark.createDataFrame(rows, "u long, e int, v double, w double"), "u", "e", "v", "w")
    x = np.array([[float(u == k) for k in range(12)] + [float(e == k) for k in (1, 2)] for u, e, _, _ in rows])
    root = np.sqrt([r[3] for r in rows])
    beta = np.linalg.lstsq(x * root[:, None], np.log([r[2] for r in rows]) * root, rcond=None)[0][:12]
    got = {r.u: r.offset_pct for r in out.collect()}
    assert np.allclose([got[k] for k in range(12)], 100 * (np.exp(beta - beta.mean()) - 1))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_block_bootstrap_repeats_and_covers(spark):
    df = spark.range(600).selectExpr("1 as g", "id % 30 as day", "cast(id % 7 + 3 as double) as num", "cast(2 as double) as den")
    a = fits.block_bootstrap(df, ["g"], "day", "num", "den", draws=100).first()
    b = fits.block_bootstrap(df.repartition(7), ["g"], "day", "num", "den", draws=100).first()
    assert (a.lo, a.hi) == (b.lo, b.hi) and a.lo <= a.ratio <= a.hi


def test_poisson_weights_have_mean_one(spark):
    assert abs(spark.range(20000).select(fits.poisson_weight(1, "id").alias("k")).agg({"k": "avg"}).first()[0] - 1) < 0.03


def test_replicates_repeat(spark):
    df = spark.range(40).selectExpr("1 as g", "cast(id as double) as x")
    run = lambda: sorted(r.value for r in fits.replicates(df, ["g"], ["x"], lambda f, rng: float(f["x"].median()), 10, 1).collect())
    assert run() == run() and len(set(run())) > 3


def brute_splits(x, threshold, least):
    def best(lo, hi):
        out = None
        for s in range(lo + least, hi - least + 1):
            a, b = np.median(x[lo:s]), np.median(x[s:hi])
            if a and abs(b / a - 1) > threshold:
                gain = np.abs(x[lo:hi] - np.median(x[lo:hi])).sum() - np.abs(x[lo:s] - a).sum() - np.abs(x[s:hi] - b).sum()
                if out is None or gain > out[0]:
                    out = (gain, s)
        return [] if out is None else best(lo, out[1]) + [out[1]] + best(out[1], hi)

    return best(0, len(x))


def test_median_segmentation():
    x = np.array([100.0] * 10 + [80] + [100] * 2 + [70] * 12)
    assert [s for _, s, _ in changes.median_splits(x, 0.15, 4)] == [13]
    rng = np.random.default_rng(4)
    for _ in range(10):
        x = np.repeat(rng.choice([50.0, 100.0, 200.0], 4), 8) * rng.uniform(0.9, 1.1, 32)
        assert [s for _, s, _ in changes.median_splits(x, 0.15, 4)] == brute_splits(x, 0.15, 4)


def test_sizes_come_from_the_final_segments(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([100.0] * 5 + [50.0] * 5 + [25.0] * 5)], "k int, t long, v double")
    got = changes.smoothed_changes(df, ["k"], "t", "v").orderBy("at").collect()
    assert [(r["at"], round(r.change, 2)) for r in got] == [(5, -0.5), (10, -0.5)]


def test_weighted_regimes_certify_a_step_and_not_noise(spark):
    step = [(1, i, 60.0, 10.0, 1) for i in range(10)] + [(1, 10 + i, 36.0, 9.0, 1) for i in range(10)]
    flat = [(2, i, 60.0, 10.0, 1) for i in range(20)]
    got = changes.weighted_regimes(spark.createDataFrame(step + flat, "k int, t long, d5 double, d7 double, pieces int"), ["k"], "t").orderBy("k", "regime").collect()
    assert [(r.k, r.start, round(r.level, 2)) for r in got] == [(1, 0, 6.0), (1, 10, 4.0), (2, 0, 6.0)]
    assert got[1].change is not None and got[1].hi < got[0].lo and got[1].confirmed_at is not None


def test_scan_finds_the_shared_step(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{k}", 24.0 * d + 12, float(rng.normal(100 * (1.5 if d >= 30 else 1), 8)), 10.0) for k in range(4) for d in range(60)]
    units = spark.createDataFrame(rows, "account string, t double, num double, den double")
    got = {r.tau: r for r in changes.scan(units, [24.0 * d for d in range(10, 51, 4)] + [720.0], permutations=2000).collect()}
    best = max(got.values(), key=lambda r: abs(r.z))
    assert best.tau == 720.0 and abs(np.exp(best.step) - 1.5) < 0.1 and best.agree and best.plan_wide and best.voting == 4
    assert best.p < 0.001 < got[240.0].p
    again = changes.scan(units, [720.0], permutations=2000).first()
    assert (again.z, again.p) == (best.z, best.p)


def test_held_states(spark):
    finds = [("ratio", 1, d, 100.0 + d) for d in range(9)] + [("ratio", -1, d, 50.0) for d in (0, 1, 4)]
    rows = changes.held_states(spark.createDataFrame(finds, "line string, sign int, day long, at double")).collect()
    up = {r.day: (r.state, r.held_days) for r in rows if r.sign == 1}
    assert up[0] == ("candidate", 1) and up[5] == ("provisional", 6) and up[6] == ("measured", 7) and up[8] == ("measured", 9)
    down = {r.day: r.held_days for r in rows if r.sign == -1}
    assert down == {0: 1, 1: 2, 4: 1}


def test_hold_states_covers_every_account(spark):
    sf_dir = "/root/testdata/sf0.01"  # several accounts
    from tidewater.operators import ordered
    from tidewater.plans import base, statistics

    want = {r.account for r in ordered.reset_brackets(base.readings(spark, sf_dir)).select("account").distinct().collect()}
    assert {r.account for r in statistics.hold_states(spark, sf_dir).select("account").distinct().collect()} == want and len(want) > 1


def test_episodes(spark):
    hits = spark.createDataFrame([("r", 0.0, 0.5), ("r", 10.0, 0.1), ("r", 100.0, 0.2)], "line string, tau double, p double")
    got = changes.episodes(hits, ["line"], "tau", 48.0, "p").orderBy("first").collect()
    assert [(r.first, r.last, r.hits, r.tau) for r in got] == [(0.0, 10.0, 2, 10.0), (100.0, 100.0, 1, 100.0)]


def test_power_grows_with_the_step(spark):
    test = lambda a, b: abs(np.log(b.mean() / a.mean())) > 0.15
    before = np.random.default_rng(6).uniform(80, 120, 40)
    rate = lambda s: changes.power(before, s, 10, 60, 1, spark, test).first().rate
    assert rate(1.4) > 0.9 > 0.3 > rate(1.0)


def test_power_of_each_account(spark):
    rng = np.random.default_rng(7)
    of = {0: rng.uniform(80, 120, 40), 1: rng.uniform(10, 200, 30)}
    df = spark.createDataFrame([(k, float(x)) for k in of for x in of[k]], "account long, x double")
    got = {r.account: (r.rate, r.trials) for r in changes.power_by(df, "account", "x", 1.2, 10, 90, 5, changes.medians_apart, block=40).collect()}
    want = {k: changes.power(np.sort(of[k]), 1.2, 10, 90, 5, spark, changes.medians_apart).first() for k in of}
    assert got == {k: (r.rate, r.trials) for k, r in want.items()}


def test_power_tests_a_block_of_trials_at_once(spark):
    df = spark.createDataFrame([(k, float(x)) for k in range(40) for x in range(5 + k % 2)], "account long, x double")
    once = lambda a, b: np.full(len(a), a.shape[0] == 40 and a.shape[1] in (5, 6) and b.shape == (40, 10))
    rows = changes.power_by(df, "account", "x", 1.2, 10, 80, 5, once, block=40).collect()
    assert len(rows) == 40 and all((r.rate, r.trials) == (1.0, 80) for r in rows)


def test_a_search_shuffles_the_instants_that_may_be_found(spark, monkeypatch):
    """The finds are those of a search that shuffles at every instant."""
    rng = np.random.default_rng(4)
    rows = [(a, 24.0 * d + 12, 10.0 * (1.6 if d >= 20 else 1) * float(np.exp(0.05 * rng.standard_normal())), 10.0) for a in range(4) for d in range(40)]
    units = spark.createDataFrame(rows, "account long, t double, num double, den double").cache()
    grid, asked, plain = [12.0 + 24 * d for d in range(2, 38)], [], changes.votes
    want, cuts, all_rows, stale = [], [], {}, grid
    while stale:
        all_rows |= changes.clear_scan(units, stale, 500, 2000, 0.01, breaks=cuts)
        flagged = [r for t, r in all_rows.items() if changes.is_flagged(r, 0.01) and all(abs(t - c) >= 48 for c in cuts)]
        if not flagged:
            break
        want.append(min(flagged, key=lambda r: (max(r["p"], 1 / 501), -abs(r["z"]), r["tau"])))
        cuts.append(want[-1]["tau"])
        stale = [t for t in grid if abs(t - cuts[-1]) <= 336]
        all_rows = {t: r for t, r in all_rows.items() if t not in stale}
    monkeypatch.setattr(changes, "votes", lambda u, taus, *a, **k: asked.append(len(taus) if k.get("permutations", a[2] if a else None) else 0) or plain(u, taus, *a, **k))
    assert changes.search(units, grid, 500, alpha=0.01, most=2000) == want and want[0]["tau"] == 492.0
    assert 0 < sum(asked) < len(grid) / 2


def test_detection_power_has_every_account(spark):
    sf_dir = "/root/testdata/sf0.01"  # several accounts
    from tidewater.plans import relational, reports

    want = {r.account for r in relational.daily(spark, sf_dir).filter("den > 0").select("account").distinct().collect()}
    assert {r.account for r in reports.detection_power(spark, sf_dir).collect()} == want and len(want) > 1


def test_no_claim_without_code():
    from tidewater import catalog

    claimed = {i for ids in catalog.covers().values() for i in ids}
    assert not claimed & {"STAT-49", "SRC-15", "STR-1", "STR-3", "STR-14", "STR-16"}


def test_pooled_rates_are_recovered_whatever_the_groups_level(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g in range(6):
        a, b, c = (rng.uniform(1, 9, 40) for _ in range(3))
        y = (1 + g) * (a + 2.5 * b + 0.4 * c) * np.exp(0.001 * rng.standard_normal(40))
        rows += list(zip([g] * 40, y.tolist(), a.tolist(), b.tolist(), c.tolist(), strict=True))
    got = fits.pooled_log_rates(spark.createDataFrame(rows, "g int, y double, a double, b double, c double"), "g", "y", ["a", "b", "c"])
    assert got["a"] == 1 and abs(got["b"] - 2.5) < 0.02 and abs(got["c"] - 0.4) < 0.02


def test_held_out_rows_are_predicted_and_covered(spark):
    rng = np.random.default_rng(13)
    a, b = rng.uniform(1, 9, 400), rng.uniform(1, 9, 400)
    y = 2 * a + 3 * b + rng.standard_normal(400)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "y": y, "a": a, "b": b, "t": np.arange(400) % 2 == 0}))
    r = fits.held_out(df, ["g"], "y", ["a", "b"], "t").first()
    assert r.n_train == r.n_test == 200 and r.error < 0.06 and 0.7 < r.coverage < 0.9
    drawn = fits.fit_draws(df, ["g"], "y", ["a", "b"], ["g", "y"], 20, 1).groupBy("name").agg({"rate": "avg"}).collect()
    assert {n: round(v) for n, v in drawn} == {"a": 2, "b": 3}
