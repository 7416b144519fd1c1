"""Constraints on published figures: each is a frame of the rows that break it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column], row: Column) -> DataFrame:
    """(name, row) of every broken rule; a rule that is null counts as broken. One pass over the table."""
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, rule in rules.items()])
    return df.select(F.explode(F.array_compact(broken)).alias("name"), row.alias("row"))


def failures(df: DataFrame, rules: Mapping[str, Column], row: Column) -> DataFrame:
    return violations(df, rules, row).groupBy("name").agg(F.count("*").alias("failures"), F.min("row").alias("example"))


def inside(figures: DataFrame, units: DataFrame, by: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Figures outside their units' least and largest value, widened; skipped with fewer than two units."""
    ends = units.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n")).filter("_n >= 2")
    out = figures.join(ends, list(by))
    return out.filter(~F.col(value).between(F.col("_lo") * (1 - tolerance), F.col("_hi") * (1 + tolerance))).drop("_lo", "_hi", "_n")


def agreeing(a: DataFrame, b: DataFrame, by: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose two figures differ by more than a relative tolerance."""
    both = a.select(*by, F.col(value).alias("a")).join(b.select(*by, F.col(value).alias("b")), list(by))
    return both.filter(F.abs(F.col("a") - F.col("b")) > tolerance * F.abs(F.col("b")))


def newest_stated(changes: DataFrame, headline: DataFrame, at: str, state: str = "state") -> DataFrame:
    """The headline if it is not the newest stated change; empty when it is."""
    newest = changes.filter(F.col(state) != "candidate").agg(F.max(at).alias("_newest"))
    return headline.crossJoin(F.broadcast(newest)).filter(~F.col(at).eqNullSafe(F.col("_newest")))


def drawn(changes: DataFrame, steps: DataFrame, key: str, state: str = "state") -> DataFrame:
    """Stated changes without a step, and steps of candidates."""
    stated = changes.filter(F.col(state) != "candidate")
    missing = stated.join(steps, key, "left_anti").select(key, F.lit("no step").alias("problem"))
    extra = steps.join(stated, key, "left_anti").select(key, F.lit("no stated change").alias("problem"))
    return missing.unionByName(extra)


def one_figure(figures: DataFrame, key: str, value: str) -> DataFrame:
    """Keys shown with more than one figure."""
    return figures.groupBy(key).agg(F.count_distinct(value).alias("figures")).filter("figures > 1")


def matched(boundaries: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has: a bijection leaves none."""
    both = boundaries.select(key, F.lit(True).alias("_a")).join(changes.select(key, F.lit(True).alias("_b")), key, "full_outer")
    return both.filter("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "no boundary").otherwise("no change").alias("problem"))


def names_hidden(leaves: DataFrame, names: Sequence[str]) -> DataFrame:
    """Leaves that hold a raw name; ``leaves`` is (path, value)."""
    import re

    return leaves.filter(F.col("value").rlike(r"\b(" + "|".join(map(re.escape, names)) + r")\b") | F.col("path").rlike(r"(^|\.)(" + "|".join(map(re.escape, names)) + r")(\.|$)"))


def fresh(df: DataFrame, ts: str, now: int, at_most: int) -> DataFrame:
    """The newest row if it is older than allowed, or a null row for an empty table."""
    return df.agg(F.max(ts).alias("newest")).filter(F.col("newest").isNull() | (F.lit(now) - F.col("newest") > at_most))


def flag_iff(df: DataFrame, flag: Column, rule: Column) -> DataFrame:
    """Rows on which a flag and the rule it stands for disagree."""
    return df.filter(~flag.eqNullSafe(rule))


# --- rules over the daily runs' state and over regimes ------------------------------------------------


def state_rules(state: DataFrame, headline: DataFrame, now: int, hold_days: int, at_most: int = 1, lead: DataFrame | None = None) -> DataFrame:
    """(rule, row) of what breaks the rules of a plan's newest run, or those between its runs.

    ``state`` is the table of daily runs; ``headline`` (plan, at) is what is published as each plan's last
    change, null for none; ``now`` is the day of publishing. Rules:

    * still_found: a change measured before is found again by the newest run;
    * kept: a change once measured stands in the newest run, at the same instant;
    * newest_change: the headline is the newest measured change;
    * drawn: a stated change has a size inside its interval;
    * one_figure: a change's decided size is the same in all runs;
    * flagged: a change is measured exactly when it was held long enough;
    * detector_ran: the newest run is at most ``at_most`` days old;
    * lead: the sentence that leads a message, (plan, at, direction, percent), says what the change at its instant was decided to be.
    """
    last = state.groupBy("plan").agg(F.max("day").alias("_last"))
    rows = state.join(last, "plan")
    name = F.concat_ws(":", "plan", "line", "sign", "at").alias("row")
    told = lambda rule, df, row=name: df.select(F.lit(rule).alias("rule"), row)
    every = rows.filter("kind = 'change'")
    new = every.filter("day = _last")
    measured = new.filter("state = 'measured'")
    key = ["plan", "line", "sign", "at"]
    newest = measured.groupBy("plan").agg(F.max("at").alias("_newest"))
    shown = last.join(headline.select("plan", "at"), "plan", "left").join(newest, "plan", "left").filter(~F.col("at").eqNullSafe(F.col("_newest")))
    parts = [
        told("still_found", measured.filter(F.col("carried") & ~F.coalesce("found_today", F.lit(False)))),
        told("kept", every.filter("state = 'measured'").select(*key).distinct().join(measured, key, "left_anti")),
        told("newest_change", shown, F.concat_ws(":", "plan", F.coalesce(F.col("at").cast("string"), F.lit("none"))).alias("row")),
        told("drawn", new.filter("state <> 'candidate'").filter(~F.coalesce(F.col("change_pct").between(F.col("lo_pct"), F.col("hi_pct")), F.lit(False)))),
        told("one_figure", every.filter("state = 'measured'").groupBy(*key).agg(F.count_distinct(F.coalesce("decided_pct", F.lit(float("inf")))).alias("n")).filter("n > 1")),
        told("flagged", flag_iff(new, F.col("state") == "measured", F.col("held_days") >= hold_days)),
        told("detector_ran", last.filter(F.lit(now) - F.col("_last") > at_most), F.col("plan").alias("row")),
    ]
    if lead is not None:
        said = measured.select("plan", "line", "sign", "at", F.when(F.col("decided_pct") > 0, "increased").otherwise("decreased").alias("_direction"), F.abs(F.round("decided_pct")).cast("int").alias("_percent"))
        parts.append(told("lead", said.join(lead, ["plan", "at"]).filter(~(F.col("direction").eqNullSafe(F.col("_direction")) & F.col("percent").eqNullSafe(F.col("_percent"))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def direct_means_direct(regimes: DataFrame, readings: DataFrame, by: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys whose newest regime is told by a cluster, but not by the median of its family's readings since it began.

    ``regimes`` is (by, regime, from_us, run_from, source, regime_family, measured_value); ``readings`` (by, start, family, value).
    """
    newest = regimes.groupBy(*by).agg(F.max_by(F.struct("from_us", "run_from", "source", "regime_family", "measured_value"), "regime").alias("r")).select(*by, "r.*").filter(F.col("source").isin("cluster", "run_cluster"))
    # a run begins with its first regime, which is null for the first of all; other regimes at their own instant
    since = F.coalesce(F.when(F.col("source") == "run_cluster", F.col("run_from")).otherwise(F.col("from_us")), F.lit(-(1 << 62)))
    own = readings.join(newest.withColumn("_since", since), list(by)).filter((F.col("start") >= F.col("_since")) & (F.col("family") == F.col("regime_family")))
    direct = own.groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("direct"))
    both = newest.join(direct, list(by), "left")
    return both.filter(~F.coalesce(F.abs(F.col("direct") - F.col("measured_value")) <= tolerance * F.abs(F.col("direct")), F.lit(False))).select(*by, "direct", "measured_value")
