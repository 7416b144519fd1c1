"""Coupled shares, joint rates and the search for several changes, against brute force and planted truth."""

import itertools

import numpy as np
import pandas as pd

from tidewater.stats import changes, fits, robust, shares


def test_least_total_equals_every_combination():
    rng = np.random.default_rng(1)
    for m, caps in [(1, [[0]]), (2, []), (3, [[0, 1], [1, 2]]), (3, [[0, 1, 2]]), (4, [[0, 1, 2, 3]]), (5, [list(range(5))])]:
        s = rng.integers(0, 50, (m, 6))
        ok = [c for c in itertools.product(range(6), repeat=m) if all(sum(c[i] for i in cap) <= 5 for cap in caps)]
        best = min(sum(s[i][k] for i, k in enumerate(c)) for c in ok)
        got = tuple(int(k) for k in shares.least_total(s, caps))
        assert got in ok and sum(s[i][k] for i, k in enumerate(got)) == best
        if m <= 3:
            assert got == min(c for c in ok if sum(s[i][k] for i, k in enumerate(c)) == best)


def test_shares_are_found_and_share_a_budget(spark):
    rng = np.random.default_rng(2)
    rows = []
    for a, share in enumerate((0.3, 0.6, 0.9)):
        for k in range(60):
            own, extra = float(rng.uniform(5, 9)), float(rng.choice([0.0, 4.0, 8.0]))
            rows.append((a, "before" if k < 30 else "after", own, extra, (own + share * extra) / (2.0 if k < 30 else 3.0)))
    rows += [(9, "before", 5.0, 0.0, 1.0), (None, None, None, None, None), (3, None, 1.0, 1.0, 1.0)]
    s = shares.scatter_by_share(spark.createDataFrame(rows, "a long, side string, own double, extra double, pct double"), "a", "side", "own", "extra", "pct")
    coupled = spark.createDataFrame([(0, 1, [[0, 1]]), (1, 1, [[0, 1]])], "a long, group int, caps array<array<long>>")
    got = {r.a: r.share for r in shares.capped_shares(s, coupled, "a").collect()}
    assert set(got) == {0, 1, 2} and abs(got[2] - 0.9) < 1e-9 and abs(got[0] - 0.3) < 1e-9 and abs(got[1] - 0.6) < 1e-9
    tight = spark.createDataFrame([(a, 1, [[0, 1, 2]]) for a in range(3)], "a long, group int, caps array<array<long>>")
    assert sum(r.share for r in shares.capped_shares(s, tight, "a").collect()) <= 1 + 1e-9


def planted(spark, rate=2.0, change=0.8):
    rng = np.random.default_rng(3)
    rows = []
    for a in range(4):
        for k in range(80):
            early = k < 40
            known, new = rng.uniform(4, 8), 0.0 if early else rng.choice([0.0, 2.0, 6.0])
            pct = (known + rate * new) / (10.0 + a) / (1.0 if early else change) * np.exp(0.01 * rng.standard_normal())
            rows.append((a, k // 4, "before" if early else "after", float(known), float(new), float(pct)))
    return spark.createDataFrame(rows, "account long, day long, side string, known double, new double, pct double"), rows


def test_joint_fit_finds_rate_and_change(spark):
    df, rows = planted(spark)
    sums = shares.joint_by_account(shares.joint_sums(df, "account", "day"), "account", "day", 20, 1).cache()
    r = shares.separable(shares.joint_interval(shares.joint_best(sums, ["draw"])), df).first()
    assert abs(r.rate - 2) < 0.05 and abs(np.exp(r.log_change) - 0.8) < 0.02 and r.separable and r.n == 160
    assert r.rate_lo < 2.05 and r.rate_hi > 1.95 and r.change_lo <= r.log_change <= r.change_hi
    level = {a: np.mean([np.log(k / d) for x, _, s, k, _, d in rows if x == a and s == "before"]) for a in range(4)}

    def ss(t):
        e = [np.log((k + np.exp(t) * n) / d) - level[a] for a, _, s, k, n, d in rows if s == "after"]
        return float(np.var(e))

    assert abs(np.log(r.rate) - fits.best_on_grid(ss, np.log(0.05), np.log(20))) < 1e-3
    out = {x.account: x for x in shares.joint_without(sums, "account").collect()}
    assert len(out) == 4 and all(x.holds and abs(x.rate - 2) < 0.1 and x.n == 120 for x in out.values())
    alone = [x for x in rows if x[0] != 2]
    again = shares.joint_best(shares.joint_by_account(shares.joint_sums(spark.createDataFrame(alone, df.schema), "account", "day"), "account", "day"), ["draw"]).first()
    assert abs(again.rate - out[2].rate) < 1e-9


def test_adopted_rates(spark):
    df, _ = planted(spark)
    fit = lambda d: shares.separable(shares.joint_interval(shares.joint_best(shares.joint_by_account(shares.joint_sums(d, "account", "day"), "account", "day", 20, 1), ["draw"])), d)
    rates = spark.createDataFrame([("a", 1.0, None, "given"), ("b", 3.0, 5.0, "given")], "family string, rate double, list_ratio double, source string")
    got = {r.family: r for r in shares.adopted(rates, fit(df), "b", 1.5).collect()}
    assert got["a"].rate == 1.0 and abs(got["b"].rate - 3.0) < 0.1 and got["b"].source == "joint fit"
    unmixed = df.withColumn("new", df["new"] * 0)
    got = {r.family: r for r in shares.adopted(rates, fit(unmixed), "b", 1.5).collect()}
    assert (got["b"].rate, got["b"].source) == (5.0, "list price")
    got = {r.family: r for r in shares.adopted(rates, fit(df.limit(0)), "b", 1.5).collect()}
    assert (got["b"].rate, got["b"].source) == (3.0, "given")


def test_factor_within_equals_a_fit_with_dummies(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(rng.poisson(np.exp(1 + 0.2 * g + 0.7 * x)))) for g in range(6) for x in rng.random(30)]
    rows += [(7, 0.5, 3.0), (8, 0.1, 0.0), (8, 0.9, 0.0)]
    got = shares.factor_within(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "y", "x").first()
    kept = [r for r in rows if r[0] < 6]
    design = np.array([[1.0, x, *(float(g == k) for k in range(1, 6))] for g, x, _ in kept])
    b, se, phi = fits.irls_poisson(np.array([r[2] for r in kept]), design)
    assert abs(got.factor - np.exp(b[1])) < 1e-6 and abs(got.dispersion - phi) < 1e-6 and abs(got.hi - np.exp(b[1] + 1.96 * se[1])) < 1e-5 and (got.n, got.levels) == (180, 6)
    assert shares.factor_within(spark.createDataFrame(rows[:10], "g int, x double, y double"), ["g"], "y", "x").count() == 0


def test_source_weights_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(80):
        c, s, h = rng.uniform(2, 6, 3)
        rows.append((int(k % 2), float((c + 0.7 * s + 1.6 * h) * (1 + k % 2) * np.exp(0.05 * rng.standard_normal())), float(c), float(s), float(h), float(rng.uniform(1, 3))))
    got = fits.source_weights(spark.createDataFrame(rows, "era int, y double, c double, s double, h double, w double"), "era", "y", "c", "s", "h", "w", 31).first()
    era, y, c, s, h, w = (np.array(x) for x in zip(*rows, strict=True))
    grid = np.exp(np.linspace(np.log(0.2), np.log(3), 31))
    cells = {}
    for a, b in itertools.product(grid, grid):
        e, total = np.log((c + a * s + b * h) / y), 0.0
        for k in (0, 1):
            m = np.average(e[era == k], weights=w[era == k])
            total += (w[era == k] * (e[era == k] - m) ** 2).sum()
        cells[a, b] = total
    best = min(cells, key=cells.get)
    inside = [k for k, v in cells.items() if v <= cells[best] * (1 + 3.84 / 76)]
    want = [best[0], min(k[0] for k in inside), max(k[0] for k in inside), best[1], min(k[1] for k in inside), max(k[1] for k in inside)]
    assert np.allclose([got.first_weight, got.first_lo, got.first_hi, got.second_weight, got.second_lo, got.second_hi], want)


def two_changes(spark):
    rng = np.random.default_rng(6)
    rows = []
    for a in range(4):
        for day in range(60):
            level = (1 + 0.1 * a) * (1.0 if day < 20 else 1.6 if day < 40 else 0.9)
            den = rng.uniform(8, 12)
            rows.append((f"a{a}", 24.0 * day + 12, float(level * den * np.exp(0.05 * rng.standard_normal())), float(den)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["account", "t", "num", "den"]))


def test_search_finds_both_changes_and_no_third(spark):
    u = two_changes(spark)
    grid = [24.0 * d for d in range(8, 54)]
    found = changes.search(u, grid, permutations=2000, most=8000)
    assert sorted(r["tau"] for r in found) == [480.0, 960.0]
    assert changes.search(u, grid, permutations=2000, most=2000, breaks=[480.0, 960.0]) == []
    size = {(r.tau, r.account): r for r in changes.sizes(u, [480.0, 960.0], 1.2).collect()}
    r = size[480.0, "a1"]
    assert len(size) == 8 and r.lo < 60 < r.hi and abs(r.own_pct - 60) < 8 and abs(r.without_pct - 60) < 6
    again = changes.found_again(u, grid, 480.0, 1, (470.0, 490.0), [480.0, 960.0], permutations=2000, most=2000)
    assert again["found_today"] and not changes.found_again(u, grid, 480.0, -1, (470.0, 490.0), [480.0, 960.0], permutations=2000, most=2000)["found_today"]
    assert changes.found_again(u, [], 480.0, 1, (470.0, 490.0), [480.0])["p"] is None


def test_a_find_that_goes_is_withdrawn(spark):
    finds = spark.createDataFrame([("l", 1, 1, 10.0), ("l", 1, 2, 500.0), ("l", 1, 5, 500.0)], "line string, sign int, day long, at double")
    got = sorted((r.day, r.at, r.state) for r in changes.held_states(finds, withdrawn=True).collect())
    assert got == [(1, 10.0, "candidate"), (2, 10.0, "withdrawn"), (2, 500.0, "candidate"), (3, 500.0, "withdrawn"), (5, 500.0, "candidate")]


def test_factor_beside_a_regime_equals_a_fit_with_dummies(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(x), int(k >= 20), float(rng.poisson(np.exp(1 + 0.2 * g + 0.5 * x - 0.4 * (k >= 20))))) for g in range(4) for k, x in enumerate(rng.random(40))]
    got = shares.factor_within(spark.createDataFrame(rows, "g int, x double, late int, y double"), ["g"], "y", "x", ["late"]).first()
    design = np.array([[1.0, x, late, *(float(g == k) for k in range(1, 4))] for g, x, late, _ in rows])
    b, se, phi = fits.irls_poisson(np.array([r[3] for r in rows]), design)
    assert abs(got.factor - np.exp(b[1])) < 1e-6 and abs(got.lo - np.exp(b[1] - 1.96 * se[1])) < 1e-5 and abs(got.dispersion - phi) < 1e-6


def test_pooled_draws_and_fits_without_a_group(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(5):
        for k in range(40):
            a, b, c = (float(v) for v in rng.uniform(1, 9, 3))
            rows.append((g, k, float((1 + g) * (a + 2.5 * b + 0.4 * c) * np.exp(0.05 * rng.standard_normal())), a, b, c))
    df = spark.createDataFrame(rows, "g int, k int, y double, a double, b double, c double").cache()
    names = ["a", "b", "c"]
    whole = fits.pooled_log_rates(df, "g", "y", names)
    drawn = fits.pooled_rate_draws(df, "g", "y", names, ["g", "k"], 20).toPandas()
    first = drawn[drawn["draw"] == 0].set_index("name")["rate"]
    assert all(abs(first[c] - whole[c]) < 1e-4 for c in names) and len(drawn) == 63
    spread = drawn[(drawn["draw"] > 0) & (drawn["name"] == "b")]["rate"]
    assert 0 < spread.std() < 0.5 and spread.min() < 2.5 < spread.max()
    got = {(r.g, r.name): r.rate for r in fits.pooled_rates_without(df, "g", "y", names, block=2).collect()}
    assert len(got) == 15
    for g in range(5):
        again = fits.pooled_log_rates(df.filter(f"g <> {g}"), "g", "y", names)
        assert all(abs(got[g, c] - again[c]) < 1e-6 * again[c] for c in names)



def plain_joint(rows, s2):
    """Levels and change as Huber locations, the rate by golden sections of the loss: nested, row by row."""
    level, after = {}, []
    for a in {r[0] for r in rows}:
        x = [(np.log(k / p), s2 + v) for b, _, side, p, k, n, v in rows if b == a and side == "before" and n == 0]
        level[a] = fits.huber(*map(np.array, zip(*x, strict=True)), rounds=500)[0]
    after = [(k, n, p, level[a], s2 + v) for a, _, side, p, k, n, v in rows if side == "after"]
    k, n, p, lv, var = map(np.array, zip(*after, strict=True))

    def loss(t):
        e = np.log((k + np.exp(t) * n) / p) - lv
        m = fits.huber(e, var, rounds=500)[0]
        z = np.abs(e - m) / np.sqrt(var)
        return float(np.where(z <= 1.345, z * z / 2, 1.345 * (z - 1.345 / 2)).sum()), m

    t = fits.best_on_grid(lambda t: loss(t)[0], np.log(0.05), np.log(20), rounds=90)
    return np.exp(t), loss(t)[1]


def test_robust_joint_fit_equals_a_fit_of_rows_and_resists_outliers(spark):
    df, rows = planted(spark)
    rng = np.random.default_rng(11)
    bad = [(a, day, side, known, new, pct * (3.0 if side == "after" and rng.random() < 0.12 else 1.0)) for a, day, side, known, new, pct in rows]
    table = [(a, day, side, pct, known, new, 1e-4 * (1 + day % 3)) for a, day, side, known, new, pct in bad]
    df = spark.createDataFrame(table, "account long, day long, side string, pct double, known double, new double, variance double")
    plain = shares.joint_best(shares.joint_by_account(shares.joint_sums(df, "account", "day"), "account", "day"), ["draw"]).first()
    s2 = robust.scatter(df, "account", plain.rate, "variance")
    fit = robust.joint_fit(df, "account", "day", "variance", (np.log(plain.rate), plain.log_change), s2, 200, 5).toPandas()
    rate, change = plain_joint(table, s2)
    whole = fit[fit["draw"] == 0].iloc[0]
    assert abs(whole["rate"] - rate) < 1e-5 * rate and abs(whole["log_change"] - change) < 1e-6 and whole["n"] == 160
    assert abs(whole["rate"] - 2) < 0.05 and abs(np.exp(plain.log_change) - 0.8) > 2 * abs(np.exp(whole["log_change"]) - 0.8)
    assert len(fit) == 201 and fit["rate"].quantile(0.025) < 2 < fit["rate"].quantile(0.975)
    out = shares.joint_interval(spark.createDataFrame(fit)).first()
    assert out.rate_lo <= out.rate <= out.rate_hi


def test_a_draw_is_the_fit_of_its_repeated_rows(spark):
    _, rows = planted(spark)
    table = [(a, day, side, pct, known, new, 1e-4) for a, day, side, known, new, pct in rows]
    schema = "account long, day long, side string, pct double, known double, new double, variance double"
    df = spark.createDataFrame(table, schema)
    fit = {r.draw: r for r in robust.joint_fit(df, "account", "day", "variance", (0.5, -0.1), 1e-4, 3, 5).collect()}
    from pyspark.sql import functions as F

    key = {(r.account, r.day): r.k for r in df.select("account", "day", F.xxhash64(F.lit(5), "account", "day").alias("k")).distinct().collect()}
    for draw in (1, 3):
        counts = {k: int(robust.poisson_draws(np.array([v], np.int64).view(np.uint64), 3)[draw, 0]) for k, v in key.items()}
        rate, change = plain_joint([r for r in table for _ in range(counts[r[0], r[1]])], 1e-4)
        assert abs(fit[draw].rate - rate) < 1e-5 * rate and abs(fit[draw].log_change - change) < 1e-6


def test_poisson_draws_have_mean_and_variance_one():
    x = robust.poisson_draws(np.arange(2000, dtype=np.uint64) * np.uint64(977), 50)
    assert (x[0] == 1).all() and abs(x[1:].mean() - 1) < 0.02 and abs(x[1:].var() - 1) < 0.05


def test_fit_draws_equal_fits_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(g, k, float(a + 2 * b + rng.standard_normal()), float(a), float(b), float(c)) for g in range(2) for k in range(40) for a, b, c in [rng.uniform(0, 9, 3)]]
    df = spark.createDataFrame(rows, "g int, k int, y double, a double, b double, c double")
    got = {(r.g, r.draw, r.name): r.rate for r in fits.fit_draws(df, ["g"], "y", ["a", "b", "c"], ["g", "k"], 6, 3).collect()}
    counts = {(r.g, r.k, r.draw): r.n for r in df.select("g", "k", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("draw")).withColumn("n", fits.poisson_weight(3, "g", "k", "draw")).collect()}
    assert len(got) == 36
    for g in range(2):
        for draw in range(6):
            own = np.array([r[2:] for r in rows if r[0] == g for _ in range(counts[r[0], r[1], draw])])
            want = fits.nnls(own[:, 1:], own[:, 0])
            assert all(abs(got[g, draw, c] - v) < 1e-7 for c, v in zip("abc", want, strict=True))


def test_joint_sums_leave_no_join_to_the_planner(spark):
    """The grid multiplies rows where the planner's estimates do not see it: a join of such rows is broadcast whole."""
    rows = spark.createDataFrame([(a, d, "before" if d < 6 else "after", 2.0, 3.0 + a + d, 0.0 if d < 6 else 1.0) for a in range(4) for d in range(9)] + [(9, 1, "before", 1.0, 1.0, 0.0), (None, 1, "after", 1.0, 1.0, 0.0)], "account int, day int, side string, pct double, known double, new double")
    by_account = shares.joint_by_account(shares.joint_sums(rows, "account", "day", 11), "account", "day", 2)
    assert "Join" not in by_account._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.account, r.g): r for r in by_account.filter("draw = 0").collect()}
    assert {a for a, _ in got} == {0, 1, 2, 3} and len(got) == 44
    lo, hi = np.log(shares.RATE_BOUNDS)
    level = np.mean([np.log((3.0 + 2 + d) / 2) for d in range(6)])
    e = np.array([np.log((3.0 + 2 + d + np.exp(lo + 4 * (hi - lo) / 10)) / 2) - level for d in range(6, 9)])
    assert got[2, 4].n == 3 and np.allclose([got[2, 4].s, got[2, 4].q], [e.sum(), (e * e).sum()])


def test_many_fits_without_a_group_read_the_rows_a_few_times(spark, monkeypatch):
    """Refits without each of many groups equal those that read all other rows, without a pass a block of groups."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(30):
        for _ in range(12):
            a, b, c = (float(v) for v in rng.uniform(1, 9, 3))
            rows.append((g, float((1 + g) * (a + (9 if g == 3 else 2.5) * b + 0.4 * c) * np.exp(0.1 * rng.standard_normal())), a, b, c))
    rows += [(None, 2.0, 1.0, 1.0, 3.0), (None, 5.0, 2.0, 1.0, 3.0), (30, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, y double, a double, b double, c double").cache()
    names, passes, plain = ["a", "b", "c"], [], fits.centred_sums
    whole = fits.pooled_log_rates(df, "g", "y", names)
    start = np.log([whole[c] for c in names[1:]])
    want = {(r.g, r.name): r.rate for r in fits._read_again(df, "g", "y", names, df.select("g").distinct(), start, 30, 64).collect()}
    monkeypatch.setattr(fits, "centred_sums", lambda *a, **k: passes.append(1) or plain(*a, **k))
    got = {(r.g, r.name): r.rate for r in fits.pooled_rates_without(df, "g", "y", names, whole, block=2).collect()}
    assert len(passes) <= 30 and got.keys() == want.keys() and len(got) == 96
    assert all(abs(got[k] - v) < 1e-6 * v for k, v in want.items())


def test_fits_of_many_rounds_read_a_stored_table(spark, sf_dir, monkeypatch):
    """Each round reads the rows: they must not be made anew from the events."""
    from tidewater.plans import figures, solvers

    plans = []
    stored = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    fit, joint = fits.pooled_log_rates, shares.joint_sums
    monkeypatch.setattr(fits, "pooled_log_rates", lambda df, *a, **k: stored(df) or fit(df, *a, **k))
    monkeypatch.setattr(shares, "joint_sums", lambda df, *a, **k: stored(df) or joint(df, *a, **k))
    figures.pooled_family_rates(spark, sf_dir)
    solvers.absorbed_rates(spark, sf_dir)
    assert len(plans) == 3 and not any("Window" in p or "Join" in p for p in plans)
