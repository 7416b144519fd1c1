"""Regimes between changes, each told by a cluster of readings or carried from the one before.

A change whose size holds no change does not move the level: the regimes it joins are one run. A run of
several regimes with enough readings is told by one cluster; else a regime is told by its own; else it is the
one before, times the change's size where that is one, or as it was. The cluster of a family other
than the anchor's, behind a change of known size, is converted at the rate that makes the step equal
that size (the bridge rate). Everything is joins, sums and windows over a key's regimes: readings are
counted into their regimes and never kept together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.operators.cut import written

#: Readings that tell a regime.
LEAST = 5


def regimes_of(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, regime, run, start, until, ratio, lo, hi, scaled): regime 0 lies before the first change.

    ``changes`` is (by, at, ratio, lo, hi, scaled), one row a change.
    """
    w = W.partitionBy(*by).orderBy("start")
    later = changes.select(*by, F.col("at").alias("start"), "ratio", "lo", "hi", "scaled").withColumn("regime", F.row_number().over(w).cast("int"))
    first = changes.select(*by).distinct().withColumns({"start": F.lit(None).cast("bigint"), "ratio": F.lit(None).cast("double"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "scaled": F.lit(True), "regime": F.lit(0)})
    own = W.partitionBy(*by).orderBy("regime")
    out = first.unionByName(later)
    return out.withColumns({"until": F.lead("start").over(own), "run": F.sum((F.col("scaled") & (F.col("regime") > 0)).cast("int")).over(own).cast("int")})


def placed(readings: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Readings with the regime that they start in: a change at the same instant comes first."""
    given = readings.withColumn("_change", F.lit(0)).unionByName(changes.select(*by, F.col("at").alias("start"), F.lit(1).alias("_change")), allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("start", F.desc("_change")).rowsBetween(W.unboundedPreceding, 0)
    known = changes.select(*by).distinct()
    return given.withColumn("regime", F.sum("_change").over(w).cast("int")).filter("_change = 0").drop("_change").join(known, list(by), "left_semi")


def clusters(placed_: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key: the family with the most readings, how many, and its median, least and largest value, own and in the anchor's units."""
    stats = placed_.groupBy(*by, "family").agg(
        F.count("*").alias("n"), F.median("value").alias("m"), F.min("value").alias("m_lo"), F.max("value").alias("m_hi"), F.median("anchor_value").alias("a"), F.min("anchor_value").alias("a_lo"), F.max("anchor_value").alias("a_hi")
    )
    best = F.max_by(F.struct("family", "n", "m", "m_lo", "m_hi", "a", "a_lo", "a_hi"), F.struct("n", F.expr("-ascii(family)"), "family"))
    return stats.groupBy(*by).agg(best.alias("c")).select(*by, "c.*")


def cluster_regimes(changes: DataFrame, readings: DataFrame, by: Sequence[str], anchor: str, least: int = LEAST) -> DataFrame:
    """One row a regime. ``readings`` is (by, start, family, value, anchor_value)."""
    by = list(by)
    changes = written(changes.select(*by, "at", "ratio", "lo", "hi", "scaled"), "changes")
    spans = regimes_of(changes, by)
    at = written(placed(readings.select(*by, "start", "family", "value", "anchor_value"), changes, by), "placed")
    at = at.join(spans.select(*by, "regime", "run"), [*by, "regime"])
    own = clusters(at, [*by, "regime"])
    runs = clusters(at, [*by, "run"]).filter(F.col("n") >= least)
    many = spans.groupBy(*by, "run").agg(F.count("*").alias("regimes"), F.min_by("start", "regime").alias("run_from"), F.min("regime").alias("run_first")).filter("regimes > 1")
    runs = runs.join(many, [*by, "run"]).select(*by, "run", "run_from", "run_first", F.struct("family", "n", "m", "m_lo", "m_hi", "a", "a_lo", "a_hi").alias("r"))
    rows = spans.join(runs, [*by, "run"], "left").join(own.select(*by, "regime", F.struct("family", "n", "m", "m_lo", "m_hi", "a", "a_lo", "a_hi").alias("o")), [*by, "regime"], "left")

    order = W.partitionBy(*by).orderBy("regime")
    past, so_far = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    in_run, n = F.col("r").isNotNull(), F.coalesce(F.col("o.n"), F.lit(0))
    rows = rows.withColumns({"_n": n, "_told": in_run | (n >= least)})
    # the first regime with a reading is told by it, however few there are
    told_before = F.coalesce(F.max(F.col("_told") | (F.col("_n") > 0)).over(past), F.lit(False))
    rows = rows.withColumn("_before", told_before).withColumn("_told", F.col("_told") | (~F.col("_before") & (F.col("_n") > 0)))
    rows = rows.withColumn("c", F.when(F.col("_told"), F.coalesce("r", "o")))
    step = (F.col("regime") > 0) & F.col("scaled")
    goes_on = in_run & (F.col("regime") > F.col("run_first"))
    kind = (
        F.when(goes_on, "goes_on").when(F.col("_told") & F.col("_before") & step & (F.col("c.family") != anchor), "bridged").when(F.col("_told"), "told").when(step, "scaled").otherwise("carried")
    )
    rows = rows.withColumn("_kind", kind)
    is_ = lambda *kinds: F.col("_kind").isin(*kinds)
    rows = rows.withColumns({"_base": F.sum(is_("told").cast("int")).over(so_far), "_span": F.sum(is_("told", "bridged").cast("int")).over(so_far)})

    def chained(group: str, start: Column, factor: Column) -> Column:
        """The group's first figure times what followed."""
        w = W.partitionBy(*by, group).orderBy("regime").rowsBetween(W.unboundedPreceding, 0)
        return F.first(start).over(w) * F.exp(F.sum(F.coalesce(F.log(factor), F.lit(0.0))).over(w))

    rows = rows.withColumn("value", F.when(F.col("_base") > 0, chained("_base", F.col("c.a"), F.when(is_("bridged", "scaled"), F.col("ratio")))))
    rate = F.col("value") / F.col("c.m")
    rows = rows.withColumns({"_lo": F.when(is_("bridged"), F.col("c.m_lo") * rate).otherwise(F.col("c.a_lo")), "_hi": F.when(is_("bridged"), F.col("c.m_hi") * rate).otherwise(F.col("c.a_hi")), "bridge_rate": F.when(is_("bridged"), rate)})
    told = F.col("_base") > 0
    thin = lambda c: F.when(is_("scaled"), F.col(c))
    rows = rows.withColumns({
        "low": F.when(told, chained("_span", F.col("_lo"), thin("lo"))), "high": F.when(told, chained("_span", F.col("_hi"), thin("hi"))),
        "measured_value": F.when(told, chained("_span", F.col("c.m"), thin("ratio"))), "measured_lo": F.when(told, chained("_span", F.col("c.m_lo"), thin("lo"))), "measured_hi": F.when(told, chained("_span", F.col("c.m_hi"), thin("hi"))),
        "measured_family": F.last("c.family", ignorenulls=True).over(so_far),
    })
    source = F.when(in_run, "run_cluster").when(F.col("_told"), "cluster").when(step, "scaled").otherwise("carried")
    rows = rows.withColumn("source", source)
    return rows.select(
        *by, "regime", F.col("start").alias("from_us"), "until", "source", "value", F.col("low").alias("lo"), F.col("high").alias("hi"), "measured_family", "measured_value", "measured_lo", "measured_hi",
        F.coalesce("r.family", "o.family").alias("regime_family"), F.coalesce("r.n", "_n").alias("n_regime_family"), "run_from", "bridge_rate",
    )
