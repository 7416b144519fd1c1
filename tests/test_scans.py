"""Scans on literal readings: the edge cases that decide a result."""

import random
from statistics import median

from tidewater.functions import values as V
from tidewater.operators import asof, ordered, rollup, windows

M, H = V.MINUTE, V.HOUR
READING = "account int, ts_us long, seq long, five_hour double, seven_day double, resets_us long, seven_resets_us long"


def readings(spark, *rows):
    """(minute, five, seven, reset minute or None)."""
    return spark.createDataFrame([(1, t * M, i, float(f) if f is not None else None, float(s), None if r is None else r * M, 10_000 * M) for i, (t, f, s, r) in enumerate(rows)], READING)


def closed(spark, *rows, threshold=10):
    pairs = ordered.reading_pairs(readings(spark, *rows), 15 * M)
    return sorted((r.start_us // M, r.end_us // M, r.delta_pct, r.windows) for r in ordered.stretches(pairs, threshold)[0].collect())


def test_overshoot_is_thrown_away(spark):
    deltas, at, rows = [4, 7, 3, 12, 1, 9, 2], 0, [(0, 0, 0, 300)]
    for i, d in enumerate(deltas):
        at += d
        rows.append(((i + 1) * 10, at, 0, 300))
    assert [x[2] for x in closed(spark, *rows)] == [11, 15, 10]


def test_a_stretch_goes_on_over_a_reset_in_a_new_piece(spark):
    got = closed(spark, (0, 0, 0, 300), (10, 6, 0, 300), (20, 2, 0, 600), (30, 7, 0, 600))
    assert got == [(0, 30, 11.0, 2)]


def test_reset_rules(spark):
    jitter = readings(spark, (0, 5, 0, 300), (10, 6, 0, 300)).toPandas()
    jitter.loc[1, "resets_us"] += 59 * V.SECOND
    one = lambda df: [r.is_reset for r in ordered.reading_pairs(df, 15 * M).collect()]
    assert one(spark.createDataFrame(jitter, READING)) == [False]
    assert one(readings(spark, (0, 5, 0, 300), (10, 6, 0, 302))) == [True]
    assert one(readings(spark, (0, 5, 0, None), (10, 4, 0, None))) == [True]
    assert one(readings(spark, (295, 5, 0, 300), (301, 6, 0, None))) == [True]
    assert one(readings(spark, (0, 5, 0, None), (10, 6, 0, 400))) == [True]
    assert one(readings(spark, (0, 0, 0, None), (10, 6, 0, 400))) == [False]


def test_crossings_of_a_jump_share_a_bracket_and_an_outage_is_not_bridged(spark):
    df = readings(spark, (0, 1, 0, 300), (10, 4, 0, 300), (60, 9, 0, 300), (70, 10, 0, 300), (80, 3, 0, 600), (90, 4, 0, 600))
    got = [(r.lower_us // M, r.upper_us // M, r.value, r.segment) for r in ordered.crossings(df, "five_hour", "resets_us", 15 * M).orderBy("upper_us", "value").collect()]
    assert [x[:3] for x in got] == [(0, 10, 2), (0, 10, 3), (0, 10, 4), (60, 70, 10), (80, 90, 4)]
    assert len({x[3] for x in got}) == 3


def test_two_point_jump_gives_one_empty_step(spark):
    df = readings(spark, (0, 0, 1, 300), (10, 0, 2, 300), (20, 0, 4, 300), (30, 0, 5, 300))
    steps = ordered.unit_steps(ordered.crossings(df, "seven_day", "seven_resets_us", 15 * M)).orderBy("value").collect()
    assert [(r.start_us // M, r.end_us // M, r.value) for r in steps] == [(10, 20, 3), (20, 20, 4), (20, 30, 5)]


def test_window_points_join_pieces_of_one_window_only(spark):
    rows = [(0, 0, 0, 300), (10, 5, 1, 300), (40, 6, 1, 300), (50, 9, 2, 300), (310, 0, 2, 600), (320, 4, 2, 600)]
    got = [(r.d5, r.d7, r.pieces) for r in ordered.window_points(readings(spark, *rows), 15 * M).orderBy("window_us").collect()]
    assert got == [(8.0, 2.0, 2), (4.0, 0.0, 1)]


def test_bursts_split_at_exactly_the_gap(spark):
    df = spark.createDataFrame([(1, t * M, t) for t in (0, 44, 89, 134)], "a int, ts long, i long")
    assert [r.burst for r in ordered.bursts(df, ["a"], "ts", ["i"], 45 * M).orderBy("ts").collect()] == [0, 0, 1, 2]


def test_asof_half_open_ties_and_buckets(spark):
    right = spark.createDataFrame([(1, 10, 0, "a"), (1, 10, 1, "b"), (1, 20, 2, "c")], "k int, t long, o long, v string")
    left = spark.createDataFrame([(1, t) for t in (5, 10, 19, 20, 95)], "k int, at long")
    for bucket in (None, 7, 30):
        got = [r.v for r in asof.asof_backward(left, right, ["k"], "at", "t", ["v"], ["o"], bucket=bucket).orderBy("at").collect()]
        assert got == [None, "b", "b", "c", "c"]
    strict = [r.v for r in asof.asof_backward(left, right, ["k"], "at", "t", ["v"], ["o"], inclusive=False).orderBy("at").collect()]
    assert strict == [None, None, "b", "b", "c"]


def test_asof_random_against_brute_force(spark):
    random.seed(4)
    right = [(random.randrange(3), random.randrange(200), i) for i in range(60)]
    left = [(random.randrange(4), random.randrange(220)) for _ in range(120)]
    got = asof.asof_backward(spark.createDataFrame(left, "k int, at long"), spark.createDataFrame(right, "k int, t long, o long"), ["k"], "at", "t", ["o"], ["o"], bucket=25)
    want = sorted((k, a, max(((t, o) for j, t, o in right if j == k and t <= a), default=(None, None))[1] or None) for k, a in left)
    assert sorted((r.k, r["at"], r.o or None) for r in got.collect()) == sorted(want, key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0)) or sorted(map(repr, ((r.k, r["at"], r.o or None) for r in got.collect()))) == sorted(map(repr, want))


def test_overlaps_come_out_once(spark):
    random.seed(5)
    span = lambda: (a := random.randrange(300), a + random.randrange(80))
    left, right = [(i, *span()) for i in range(40)], [(i, *span()) for i in range(40)]
    a = spark.createDataFrame([(1, *x) for x in left], "k int, i int, s long, e long")
    b = spark.createDataFrame([(1, *x) for x in right], "k int, j int, u long, v long")
    for closed_ in (False, True):
        meets = {(i, j) for i, s, e in left for j, u, v in right if (s <= v and u <= e if closed_ else s < v and u < e)}
        got = [(r.i, r.j) for r in asof.overlapping(a, b, ["k"], ("s", "e"), ("u", "v"), 50, closed=closed_).collect()]
        assert len(got) == len(set(got)) and set(got) == meets
        assert {r.i for r in asof.overlapping(a, b, ["k"], ("s", "e"), ("u", "v"), 50, "left_semi", closed_).collect()} == {i for i, _ in meets}
        assert {r.i for r in asof.overlapping(a, b, ["k"], ("s", "e"), ("u", "v"), 50, "left_anti", closed_).collect()} == {i for i, _, _ in left} - {i for i, _ in meets}


def verdicts(rates, tolerance=0.15, bootstrap=5, least=4, lookback=8):
    """A second reading of the rule, over a whole list."""
    out, pool, i = {}, [], 0
    while i < len(rates):
        if len(pool) < least:
            batch = []
            while i < len(rates) and sum(r > 0 for r in batch) < bootstrap:
                batch.append(rates[i])
                i += 1
            start = i - len(batch)
            if sum(r > 0 for r in batch) < bootstrap:
                out |= {start + k: "unjudged" for k in range(len(batch))}
                break
            level = median(r for r in batch if r > 0)
        else:
            batch, start, level = [rates[i]], i, median(pool[-lookback:])
            i += 1
        for k, r in enumerate(batch):
            out[start + k] = "unaccounted" if r * 1.05 < level * (1 - tolerance) else "surplus" if r * 0.95 > level * (1 + tolerance) else "accepted"
            if out[start + k] == "accepted":
                pool.append(r)
    return [out[k] for k in range(len(rates))]


def test_judge_against_a_second_reading(spark):
    random.seed(6)
    for trial in range(3):
        rates = [0.0 if random.random() < 0.1 else random.choice([1, 1, 1, 2, 0.4]) * random.uniform(0.9, 1.1) for _ in range(60 if trial else 4)]
        df = spark.createDataFrame([(1, 0, i, i + 1, r, r * 0.95, r * 1.05, 0) for i, r in enumerate(rates)], "account int, segment int, start_us long, end_us long, rate double, lo double, hi double, unpriced long")
        assert [r.status for r in ordered.judge(df).orderBy("end_us").collect()] == verdicts(rates)


def test_withheld_runs_skip_what_was_not_judged(spark):
    states = ["accepted", "surplus", "unpriced", "surplus", "unaccounted", "accepted", "surplus"]
    df = spark.createDataFrame([(1, i, i + 1, 2.0, s, 1.0) for i, s in enumerate(states)], "account int, start_us long, end_us long, rate double, status string, reference double")
    got = [(r.status, r.start_us, r.end_us, r.n, r.step) for r in ordered.withheld_runs(df).orderBy("start_us").collect()]
    assert got == [("surplus", 1, 4, 2, 1.0), ("unaccounted", 4, 5, 1, 1.0), ("surplus", 6, 7, 1, 1.0)]


def test_armed_steps_need_a_second_reading(spark):
    values = [100, 100, 100, 130, 100, 100, 130, 131, 130, 130, 130, 60]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series string, ts_us long, value double")
    got = [(r.at_us, r.confirmed_us, round(r.change, 2)) for r in ordered.armed_steps(df).collect()]
    assert got == [(6, 7, 0.3)]


def test_log_order_drops_the_line_stamped_ahead(spark):
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate([1, 2, 99, 3, 4, 4])] + [(None, 0, 7)], "log_id string, line_no long, ts_us long")
    assert sorted(r.ts_us for r in ordered.in_log_order(df).collect()) == [1, 2, 3, 4, 4, 7]


def test_clamped_median_keeps_full_frames(spark):
    random.seed(8)
    xs = [random.random() for _ in range(25)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)] + [(2, i, x) for i, x in enumerate(xs[:5])], "k int, i int, v double")
    got = {(r.k, r.i): r.running_median for r in windows.clamped_median(df, ["k"], ["i"], "v", 9).collect()}
    for i in range(25):
        lo = max(0, min(i - 4, 16))
        assert got[1, i] == median(xs[lo : lo + 9])
    assert all(got[2, i] == median(xs[:5]) for i in range(5))


def test_weighted_medians(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1), (2, 1.0, 1), (2, 5.0, 3)], "k int, v double, w int")
    mid = {r.k: r.weighted_median for r in rollup.weighted_median(df, ["k"], "v", "w").collect()}
    low = {r.k: r.weighted_median for r in rollup.weighted_median(df, ["k"], "v", "w", midpoint=False).collect()}
    assert mid == {1: 1.5, 2: 5.0} and low == {1: 1.0, 2: 5.0}


def test_empty_tables(spark):
    none = readings(spark, (0, 1, 1, 300)).limit(0)
    pairs = ordered.reading_pairs(none, M)
    assert ordered.stretches(pairs)[0].count() == ordered.crossings(none, "five_hour", "resets_us", M).count() == ordered.window_points(none, M).count() == 0


def test_inferred_resets(spark):
    hour = 3_600_000_000
    rows = [(1, 0, 50.0, None), (1, 1, 80.0, None), (1, 2, 0.0, None), (1, 3, 4.0, None), (1, 4, 6.0, 99), (1, 6, 7.0, None), (1, 7, 9.0, None)]  # opens at 2, ends at 7
    rows += [(2, 0, 100.0, None), (2, 4, 100.0, None), (2, 6, 3.0, None)]  # level for over five hours: not told
    rows += [(3, 0, 20.0, None), (3, 1, 0.0, None), (3, 2, 0.0, None)]  # never used: not told
    df = spark.createDataFrame([(a, t * hour, i, v, r) for i, (a, t, v, r) in enumerate(rows)], "account int, ts_us long, seq int, five_hour double, resets_us long")
    got = {(r.account, r.ts_us // hour): r.resets_us for r in ordered.inferred_resets(df).collect()}
    told = {k: v if v == 99 else v // hour for k, v in got.items() if v is not None}
    assert told == {(1, 2): 7, (1, 3): 7, (1, 4): 99, (1, 6): 7}
    assert ordered.inferred_resets(df.limit(0)).count() == 0


def test_drift_from_a_median_of_zero_equals_sql(spark, tmp_path):
    """The first values of a key may be 0, and so is their median then."""
    import datetime as dt

    import duckdb

    from tidewater import catalog

    values = {1: [0.0, 5.0, 6.0, 0.0], 2: [0.0, 0.0, 0.0, 0.0, 1.0], 3: [0.0, -2.0, 4.0], 4: [3.0, None, 3.1, 9.0]}
    rows = [(u * 100 + i, dt.datetime(2024, 1, 1, i), u, "purchase", v, "{}") for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["rolling_prev4_median_drift"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["rolling_prev4_median_drift"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) >= 9


def test_near_spans_of_other_keys_are_counted_without_pairs(spark):
    """Keys that all have a span at one time: their number counts, not their pairs."""
    from pyspark.sql import functions as F

    from tidewater.operators import asof

    rng, rows = random.Random(4), []
    for key in [*range(40), None]:
        at = rng.randrange(50)
        for _ in range(rng.randrange(12)):
            end = at + rng.choice([0, 3, 9, 60])
            rows.append((key, at, end))
            at = end + rng.choice([0, 0, 1, 7, 90])
    df = spark.createDataFrame(rows, "k int, lo bigint, hi bigint")
    for margin, bucket in ((5, 10), (1, 7), (30, 1000)):
        got = {(r.k, r.hi): r.others for r in asof.others_near(df, "k", "lo", "hi", margin, bucket).collect()}
        want = {}
        for k, lo, hi in rows:
            others = {o for o, a, b in rows if k is not None and o is not None and o != k and lo - margin < b and a < hi + margin}
            if others:
                want.setdefault((k, hi), set()).update(others)
        assert got == {k: len(v) for k, v in want.items()}
    # 3,000 keys at once are 9 million pairs, but a few rows each
    crowd = spark.range(3000).select("id", F.lit(0).cast("bigint").alias("lo"), (F.col("id") % 7 + 1).alias("hi"))
    assert {r.others for r in asof.others_near(crowd, "id", "lo", "hi", 1, 10).collect()} == {2999}


def test_corroborated_resets_pairs_no_falls(spark, sf_dir):
    from tidewater import catalog

    plan = catalog.queries()["corroborated_resets"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "other" not in joins[0]


def test_accounts_of_seven_day_steps_are_dealt_over_a_number_of_tasks_that_stays(spark, sf_dir):
    from tidewater.plans import metering

    plan = metering.seven_day_steps(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2


def test_readings_and_changes_read_stretches_that_are_stored_once(spark):
    from pyspark.sql import functions as F

    from tidewater.plans import metering, relational, runs

    folder = "/root/testdata/sf0.01"
    r, c = runs.readings_and_changes(spark, folder)
    assert not any("events" in f for df in (r, c) for f in df.inputFiles())
    s = metering.stretch_values(spark, folder).filter("nano > 0").join(relational.family_design(spark, folder), ["account", "ordinal"])
    most = F.greatest(*runs.FAMILIES)
    family = F.coalesce(*[F.when(F.col(f) == most, F.lit(f)) for f in runs.FAMILIES])
    told = s.select("account", F.col("start_us").alias("start"), family.alias("family"), (F.col("nano") / F.lit(1e11) / F.col("delta_pct")).alias("value"))
    got = r.select("account", "start", "family", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, told.collect())) and got.count() > 40


def test_accounts_of_stored_stretches_are_dealt_over_a_number_of_tasks_that_stays(spark, sf_dir, monkeypatch):
    from tidewater.plans import metering

    plans = []
    write = metering.written
    monkeypatch.setattr(metering, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    metering.stored_stretches(spark, sf_dir, ["click"])
    # no other exchange lies between the sorts of an account
    assert [p.count("REPARTITION_BY_NUM") for p in plans] == [1, 2] and plans[0].count("Exchange hashpartitioning") == 1
