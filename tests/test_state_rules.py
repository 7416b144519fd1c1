"""Each rule over the runs' state breaks on its planted fault, and only then."""

import pytest

from tidewater import checks
from tidewater.stats import daily, regimes

RULES = daily.Rules(hold_days=3, match=48.0)


def find(at):
    return {"line": "five", "sign": 1, "at": float(at), "first": at - 2.0, "last": at + 3.0}


def healthy():
    """Two plans over five days: p's change at 100 is measured on day 3 and found again since, q has none."""
    out, previous = [], []
    for day in range(1, 6):
        rows = [r for r in daily.run_day({}, day, previous, RULES, finder=lambda *_, day=day: [find(100)] if day <= 3 else []) if r["kind"] != "withdrawn"]
        for r in rows:
            if r["kind"] == "change":
                r.update(change_pct=5.0, lo_pct=1.0, hi_pct=9.0, decided_pct=5.0 if r["state"] == "measured" else None, found_today=True)
        previous = [r for r in rows if r["kind"] == "change"]
        out += [dict(r, plan="p") for r in rows] + [{k: None for k in daily.COLUMNS} | {"plan": "q", "day": day, "kind": "run", "changes": 0, "replayed": False}]
    return out


def broken(spark, rows, headline=(("p", 100.0), ("q", None)), now=5, lead=("increased", 5)):
    state = spark.createDataFrame([tuple(r[c] for c in daily.COLUMNS) for r in rows], daily.STATE)
    shown = spark.createDataFrame(list(headline), "plan string, at double")
    return sorted((r.rule, r.row.split(":")[0]) for r in checks.state_rules(state, shown, now, RULES.hold_days, lead=spark.createDataFrame([("p", 100.0, *lead)], "plan string, at double, direction string, percent int")).collect())


def last(rows):
    return next(r for r in rows if r["plan"] == "p" and r["day"] == 5 and r["kind"] == "change")


def test_a_healthy_state_breaks_nothing(spark):
    rows = healthy()
    assert last(rows)["state"] == "measured" and last(rows)["carried"] and broken(spark, rows) == []


@pytest.mark.parametrize("rule", ["still_found", "kept", "drawn", "one_figure", "flagged"])
def test_a_planted_fault_breaks_its_rule_once(spark, rule):
    rows = healthy()
    r = last(rows)
    if rule == "still_found":
        r["found_today"] = False
    elif rule == "kept":
        rows.append(dict(next(x for x in rows if x["plan"] == "p" and x["day"] == 3 and x["kind"] == "change"), at=20.0))
    elif rule == "drawn":
        r["hi_pct"] = 4.0
    elif rule == "one_figure":
        r["decided_pct"] = 6.0
    else:
        r["held_days"] = 2
    # a lead that follows the newest figure, so that only the planted fault is one
    assert broken(spark, rows, lead=("increased", round(r["decided_pct"]))) == [(rule, "p")]


def test_headline_and_age(spark):
    rows = healthy()
    assert broken(spark, rows, [("p", 30.0), ("q", None)]) == [("newest_change", "p")]
    assert broken(spark, rows, [("p", 100.0), ("q", 7.0)]) == [("newest_change", "q")]
    assert broken(spark, rows, [("q", None)]) == [("newest_change", "p")]
    assert broken(spark, [r for r in rows if not (r["plan"] == "q" and r["day"] > 3)], now=5) == [("detector_ran", "q")]


def test_lead(spark):
    assert broken(spark, healthy(), lead=("decreased", 5)) == broken(spark, healthy(), lead=("increased", 6)) == [("lead", "p")]


def test_direct_figures_of_the_newest_regime(spark):
    c = spark.createDataFrame([(1, 50, 1.5, 1.4, 1.6, True), (1, 80, 1.0, 0.9, 1.1, False), (2, 50, 1.5, 1.4, 1.6, True), (3, 50, 1.0, 0.9, 1.1, False)], "key int, at bigint, ratio double, lo double, hi double, scaled boolean")
    rows = [(k, s, f, float(v), float(v)) for k in (1, 2, 3) for s, f, v in zip(range(0, 120, 4), "aab" * 10, range(30), strict=True)]
    r = spark.createDataFrame(rows, "key int, start bigint, family string, value double, anchor_value double")
    out = regimes.cluster_regimes(c, r, ["key"], "a")
    assert checks.direct_means_direct(out, r, ["key"]).collect() == []
    stale = regimes.cluster_regimes(c, r.filter("start < 100 or key <> 2"), ["key"], "a")
    (fault,) = checks.direct_means_direct(stale, r, ["key"]).collect()
    assert fault.key == 2 and fault.direct != fault.measured_value
