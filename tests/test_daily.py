"""The daily run: its hold, its state table, and its stream against a replay."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tidewater.stats import changes, daily
from tidewater.streaming import daily as stream

LOOSE = daily.Rules(permutations=500, most=2000, alpha=0.01, hold_days=3)


def planted(days=26, at=12, size=0.6, seed=3):
    """Two plans of three accounts; the first has a shared step at day ``at`` on one of its lines."""
    rng, rows = np.random.default_rng(seed), []
    for plan, line, account, day in itertools.product("pq", ["five", "seven"], "abc", range(days)):
        den = float(rng.integers(20, 40))
        level = size if plan == "p" and line == "five" and day >= at else 1.0
        rows.append((plan, line, account, 24.0 * day + 12, den * 5 * level * float(np.exp(0.03 * rng.standard_normal())), den))
    return rows


def key(r):
    return (r.plan, r.day, r.kind, r.line or "", r.at or 0.0)


def plain(df):
    return sorted((tuple(r[c] for c in daily.COLUMNS if c != "replayed") for r in sorted(df.collect(), key=key)), key=repr)


def test_a_planted_change_is_held_measured_and_carried(spark):
    rows = sorted(daily.replay(spark.createDataFrame(planted(), daily.UNITS), LOOSE).collect(), key=key)
    held = [r for r in rows if r.kind == "change" and r.plan == "p" and r.line == "five"]
    first = held[0]
    assert first.state == "candidate" and first.sign == -1 and abs(first.at - 288) <= 36 and first.first_found == first.day
    assert [r.state for r in held[:3]] == ["candidate", "provisional", "measured"]
    done = [r for r in held if r.state == "measured"]
    assert len({r.at for r in done}) == 1 and all(r.carried and r.measured_on == first.day + 2 for r in done[1:]) and len({r.decided_pct for r in done}) == 1
    assert all(r.found_today for r in done[1:]) and abs(done[0].change_pct + 40) < 5 and done[0].lo_pct < -40 < done[0].hi_pct
    assert {r.day for r in rows if r.kind == "run" and r.plan == "q"} == set(range(1, 27))


def test_days_as_files_equal_one_replay_and_a_day_again_changes_itself_only(spark, tmp_path):
    rows = planted(days=20, at=9)
    for day, part in itertools.groupby(sorted(rows, key=lambda r: r[3]), key=lambda r: int(r[3] // 24)):
        df = spark.createDataFrame(list(part), daily.UNITS).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: pd.read_parquet(p)["t"].min())
    for i, p in enumerate(files):
        import os

        os.utime(p, (1_700_000_000 + i * 60,) * 2)
    folder = str(tmp_path / "state")
    source = spark.readStream.schema(daily.UNITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.follow(source, folder, str(tmp_path / "checkpoint"), LOOSE).awaitTermination()
    want = daily.replay(spark.createDataFrame(rows, daily.UNITS), LOOSE)
    once = plain(stream.state(spark, folder))
    assert once == plain(want) and any(r[2] == "change" for r in once)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state" / "runs").rglob("*.parquet")}
    stream.run(spark, folder, 15, LOOSE)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "state" / "runs").rglob("*.parquet")}
    assert plain(stream.state(spark, folder)) == once
    assert {p.parent.name for p in set(before.items()) ^ set(after.items()) for p in [p[0]]} == {"day=15"}


def find(at, line="five", sign=1):
    return {"line": line, "sign": sign, "at": float(at), "first": at - 2.0, "last": at + 3.0}


def days_of(finds, rules=daily.Rules(hold_days=4, match=48.0)):
    """Runs on given finds a day, through run_day."""
    previous, out = [], []
    for day, found in enumerate(finds, 1):
        rows = daily.run_day({}, day, previous, rules, finder=lambda *_, found=found: found)
        previous = [r for r in rows if r["kind"] == "change"]
        out.append(rows)
    return out


def brief(rows):
    return sorted((r["kind"], r["state"], r["held_days"], r["at"]) for r in rows if r["kind"] != "run")


def test_hold_takes_the_nearest_find_and_the_lower_median():
    runs = days_of([[find(100)], [find(110), find(140)], [find(112)], [find(104)], [], [find(500)]])
    assert brief(runs[0]) == [("change", "candidate", 1, 100.0)]
    assert brief(runs[1]) == [("change", "candidate", 1, 140.0), ("change", "provisional", 2, 100.0)]
    assert brief(runs[2]) == [("change", "provisional", 3, 110.0), ("withdrawn", "withdrawn", 1, 140.0)]
    assert brief(runs[3]) == [("change", "measured", 4, 104.0)]
    (done,) = [r for r in runs[3] if r["kind"] == "change"]
    assert (done["first_at"], done["last_at"], done["first_found"], done["measured_on"], len(done["finds"])) == (98.0, 115.0, 1, 4, 4)
    assert brief(runs[4]) == [("change", "measured", 4, 104.0)] and brief(runs[5])[0] == ("change", "candidate", 1, 500.0)


def test_withdrawn_finds_name_what_replaced_them():
    runs = days_of([[find(100)], [find(400), find(100, sign=-1)], [find(700, line="seven")]])
    assert [(r["at"], r["replaced_by"]) for r in runs[1] if r["kind"] == "withdrawn"] == [(100.0, 400.0)]
    assert sorted((r["at"], r["replaced_by"]) for r in runs[2] if r["kind"] == "withdrawn") == [(100.0, None), (400.0, None)]


@pytest.mark.parametrize("match", [10.0, 60.0])
def test_hold_equals_a_plain_version_on_random_finds(match):
    rng = np.random.default_rng(int(match))
    finds = [[find(float(x), line=rng.choice(["five", "seven"]), sign=int(rng.choice([1, -1]))) for x in rng.integers(0, 200, rng.integers(0, 4))] for _ in range(40)]
    held, measured = [], []
    for found, rows in zip(finds, days_of(finds, daily.Rules(hold_days=4, match=match)), strict=True):
        new = []
        for f in sorted(found, key=lambda f: (f["at"], f["line"], f["sign"])):
            near = [h for h in held if h[0] == f["line"] and h[1] == f["sign"] and abs(sorted(h[2])[(len(h[2]) - 1) // 2] - f["at"]) <= match]
            best = min(near, key=lambda h: abs(sorted(h[2])[(len(h[2]) - 1) // 2] - f["at"]), default=None)
            if best:
                held.remove(best)
            new.append((f["line"], f["sign"], [*(best[2] if best else []), f["at"]]))
        gone, held = held, [h for h in new if len(h[2]) < 4]
        measured += [h for h in new if len(h[2]) >= 4]
        tell = lambda hs: sorted((h[0], h[1], len(h[2]), sorted(h[2])[(len(h[2]) - 1) // 2]) for h in hs)
        told = lambda kind: sorted((r["line"], r["sign"], r["held_days"], r["at"]) for r in rows if r["kind"] == kind)
        assert told("change") == tell(held + measured) and told("withdrawn") == tell(gone)


def test_rounds_of_shuffles_add_up(spark):
    assert list(changes.rounds(2000, 100_000)) == [(0, 2000), (2000, 8000), (8000, 32_000), (32_000, 100_000)]
    rng = np.random.default_rng(1)
    t = np.arange(30) * 24.0 + 12
    _, _, u = changes.account_step(t, rng.random(30) + 1, np.ones(30), 360.0, [])
    whole = changes.shuffled(u, 360.0, "a", 7, 0, 8000)
    parts = [changes.shuffled(u, 360.0, "a", 7, *x) for x in ((0, 2000), (2000, 6000))]
    assert all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in (0, 1))
    odd = changes.shuffled(u, 360.0, "a", 7, 730, 1111)
    assert (odd[0] == whole[0][730:1841]).all()
    rows = [(a, 24.0 * d + 12, float(rng.integers(90, 110) * (1.06 if d >= 15 else 1)), 10.0) for a in "abc" for d in range(30)]
    units = spark.createDataFrame(rows, "account string, t double, num double, den double")
    near = changes.clear_scan(units, [360.0], permutations=2000, most=8000, alpha=0.001, errors=1e9)[360.0]
    once = changes.scan(units, [360.0], permutations=8000).first()
    assert near["permutations"] == (8000 if near["as_far"] else 2000) and (near["permutations"] == 2000 or near["p"] == once.p)


def test_a_plans_step_equals_the_scan_of_its_accounts(spark):
    rows = [r for r in planted() if r[0] == "p" and r[1] == "five"]
    plan = daily.plan_of(pd.DataFrame(rows, columns=["plan", "line", "account", "t", "num", "den"]))
    r = daily.step_at(plan, "five", 288.0, [], daily.Rules(permutations=500, most=500))
    units = spark.createDataFrame([x[2:] for x in rows], "account string, t double, num double, den double")
    s = changes.scan(units, [288.0], permutations=500).first()
    assert (round(r["step"], 9), round(r["z"], 9), r["p"], r["agree"], r["plan_wide"], r["voting"]) == (s.step, s.z, s.p, s.agree, s.plan_wide, s.voting)


def test_plans_of_few_bytes_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    rows = [(str(p), "five", "a", 24.0 * d + 12, 1.0, 1.0) for p in range(40) for d in range(2)]
    runs = daily.replay(spark.createDataFrame(rows, daily.UNITS).repartition(3), LOOSE, finder=lambda *_: [])
    tasks = runs.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("plan").alias("plans")).collect()
    assert len(tasks) > 4 and sum(r.plans for r in tasks) == 40


def odd_series(rng, kind):
    """Days in order, several rows a day, days without a count, or a gap."""
    t = np.arange(40) * 24.0 + 12
    if kind == "several":
        t = np.sort(np.concatenate([t, t[::3] + 5]))
    if kind == "gap":
        t = t[(t < 300) | (t > 500)]
    den = rng.integers(0 if kind == "empty" else 5, 40, len(t)).astype(float)
    return t, den * np.exp(0.3 * rng.standard_normal(len(t))) * np.where(t > 480, 1.5, 1.0) * (0 if kind == "zero" else 1), den


@pytest.mark.parametrize("kind", ["plain", "several", "empty", "gap", "zero"])
def test_steps_at_many_instants_equal_those_at_one(kind):
    rng = np.random.default_rng(5)
    for cuts in ([], [300.0, 600.0]):
        u, taus = odd_series(rng, kind), [float(x) for x in range(0, 1000, 7)]
        many = list(zip(*changes.account_steps(*u, taus, cuts), strict=True))
        one = [changes.account_step(*u, tau, cuts) for tau in taus]
        assert [bool(m[0]) for m in many] == [o is not None for o in one] and (kind == "zero") == (not any(one))
        assert all(np.allclose(m[1:], o[:2], rtol=1e-9, atol=1e-12) for m, o in zip(many, one, strict=True) if o)


def test_a_search_finds_what_a_test_of_every_instant_finds_and_steps_are_told_once():
    columns = ["plan", "line", "account", "t", "num", "den"]
    steps, asked = daily._step_at, []
    for seed in range(2):
        rows = [r for r in planted(days=40, at=20, size=0.8, seed=seed) if r[0] == "p"]
        plan, told = daily.plan_of(pd.DataFrame(rows, columns=columns)), {}
        for day in range(22, 41, 6):
            known = daily.Known(plan, 24.0 * day, told)
            bare = {line: dict(of) for line, of in known.items()}
            tested = {(line, t): daily.step_at(bare, line, t, [], LOOSE) for line in bare for t in np.arange(24.0, 24.0 * day - 24, 24.0)}
            wanted = {k for k, r in tested.items() if r and r["p"] is not None}
            assert wanted <= {(line, t) for line in bare for t in daily.likely(known, line, [k[1] for k in tested if k[0] == line], [], LOOSE)}
            assert daily.search(known, 24.0 * day, [], LOOSE) == daily.search(bare, 24.0 * day, [], LOOSE)
        daily._step_at = lambda *a: asked.append(a) or steps(*a)
        try:
            daily.search(daily.Known(plan, 960.0, told), 960.0, [], LOOSE)
        finally:
            daily._step_at = steps
    assert not asked
