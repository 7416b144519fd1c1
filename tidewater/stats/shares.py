"""Shares and rates that several accounts fit together: grids as rows, sums in Spark, small kernels on what is left."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.stats.fits import poisson_weight

#: Bounds of a new family's rate, the widest interval that still separates it, and what counts as mixed work.
RATE_BOUNDS = (0.05, 20.0)
SEPARABLE_SPAN = 1.5
MIXED_SHARE = (0.2, 0.8)
LEAST_MIXED = 3
LEAST_BEFORE = 5


def scatter_by_share(rows: DataFrame, account: str, side: str, own: str, extra: str, pct: str, steps: int = 50, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Millionths of squared scatter of log((own + share x extra) / pct) about each side's mean, by account and share.

    Shares are whole steps from 0 to ``steps``; accounts without extra work are left out. Only sums are shuffled.
    """
    k = F.lit(1.0) if weight is None else weight.cast("double")
    good = rows.filter((F.col(own) > 0) & (F.col(pct) > 0) & F.col(side).isNotNull())
    carry = good.groupBy(account).agg(F.sum(extra).alias("_x")).filter("_x > 0").select(account)
    tried = good.join(carry, account).withColumns({"_k": k, "step": F.explode(F.sequence(F.lit(0), F.lit(steps)))})
    y = F.log((F.col(own) + F.col("step") / float(steps) * F.col(extra)) / F.col(pct))
    sums = tried.withColumn("_y", y).groupBy(*keys, account, side, "step").agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col("_y")).alias("_s"), F.sum(F.col("_k") * F.col("_y") * F.col("_y")).alias("_q"))
    ss = F.coalesce(F.col("_q") - F.try_divide(F.col("_s") * F.col("_s"), F.col("_n")), F.lit(0.0))
    return sums.groupBy(*keys, account, "step").agg(F.round(F.sum(ss) * 1e6).cast("long").alias("scatter"))


def least_total(scatter: np.ndarray, caps: Sequence[Sequence[int]]) -> np.ndarray:
    """The step of each row of ``scatter`` (rows x steps) of least total, the steps of each cap's rows adding up to at most the last one.

    Up to three rows every combination is weighed, ties going to the smaller steps of the earlier rows. More
    rows share one budget, solved exactly by adding a row at a time to the best total of each budget.
    """
    m, width = scatter.shape
    if m <= 3:
        axes = np.indices((width,) * m)
        total = sum(scatter[i][axes[i]] for i in range(m))
        allowed = np.ones((width,) * m, bool)
        for cap in caps:
            allowed &= sum(axes[i] for i in cap) < width
        return np.array(np.unravel_index(np.where(allowed, total, np.iinfo(np.int64).max).argmin(), total.shape))
    best, picks = np.zeros(width, np.int64), []
    for row in scatter:
        sums = np.full((width, width), np.iinfo(np.int64).max)
        for step in range(width):
            sums[step, step:] = best[: width - step] + row[step]
        picks.append(sums.argmin(0))
        best = sums.min(0)
    left, out = int(best.argmin()), []
    for pick in reversed(picks):
        out.append(int(pick[left]))
        left -= out[-1]
    return np.array(out[::-1])


def capped_shares(scatter: DataFrame, coupled: DataFrame, account: str, steps: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """The share of each account of least scatter, coupled accounts' shares adding up to at most 1.

    ``coupled`` is (account, group, caps): caps lists the accounts of each budget of the group. A group is as
    many rows as its accounts have shares, whatever the readings. Accounts that are in no group are alone.
    """
    types = {f.name: f.dataType.simpleString() for f in scatter.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index=account, columns="step", values="scatter").sort_index()
        at = {a: i for i, a in enumerate(wide.index)}
        caps = [] if frame["caps"].iloc[0] is None else [[at[a] for a in cap if a in at] for cap in frame["caps"].iloc[0]]
        picked = least_total(wide.to_numpy(np.int64), caps)
        out = pd.DataFrame({account: wide.index, "share": picked / steps, "scatter": [int(wide.iloc[i, s]) for i, s in enumerate(picked)]})
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, account, "share", "scatter"]]

    alone = F.concat(F.lit("alone:"), F.col(account).cast("string"))
    joined = scatter.join(coupled.select(account, F.concat(F.lit("group:"), F.col("group").cast("string")).alias("group"), "caps"), account, "left").withColumn("group", F.coalesce("group", alone))
    return joined.groupBy(*keys, "group").applyInPandas(run, ", ".join([*[f"{c} {types[c]}" for c in (*keys, account)], "share double, scatter long"]))


# --- one new rate and one change of the limit -----------------------------------------------------


def joint_sums(rows: DataFrame, account: str, block: str, points: int = 161) -> DataFrame:
    """Sums that fit a new family's rate and the limit's change together: one row an account, block and rate of a log grid.

    ``rows`` is (account, block, side, known, new, pct): a percent of the meter is (known + rate x new) / (level
    x change), the level being the account's mean log of known / pct before. Accounts need ``LEAST_BEFORE``
    stretches before and one after. Blocks are summed here, so draws cost no reading again.
    """
    lo, hi = np.log(RATE_BOUNDS)
    good = rows.filter((F.col("known") + F.col("new") > 0) & (F.col("pct") > 0) & F.col(account).isNotNull())
    early, late = (F.col("side") == "before") & (F.col("new") == 0), F.col("side") == "after"
    # Rows are dealt by account before the grid multiplies them; all that follows of an account stays in its task.
    # The planner's estimates do not see that growth, so nothing here is left to a join.
    tasks, w = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), W.partitionBy(account)
    dealt = good.filter(early | late).repartition(tasks, account).withColumns({"_before": F.count_if(early).over(w), "_after": F.count_if(late).over(w)})
    usable = dealt.filter((F.col("_before") >= LEAST_BEFORE) & (F.col("_after") > 0))
    log_rate = F.lit(float(lo)) + F.col("g") * float((hi - lo) / (points - 1))
    grid = F.explode(F.when(late, F.sequence(F.lit(0), F.lit(points - 1))).otherwise(F.array(F.lit(None).cast("int")))).alias("g")
    e = F.when(F.col("g").isNotNull(), F.log((F.col("known") + F.exp(log_rate) * F.col("new")) / F.col("pct")))
    none = F.col("g").isNull()
    sums = usable.select("*", grid).withColumns({"_e": e, "_x": F.when(none, F.log(F.col("known") / F.col("pct")))})
    each = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = sums.groupBy(account, block, "g").agg(F.count("g").alias("n"), each("_e").alias("s"), each(F.col("_e") * F.col("_e")).alias("q"), F.count_if(none).alias("bn"), each("_x").alias("bs"))
    return out.select(account, block, "g", log_rate.alias("log_rate"), "n", "s", "q", "bn", "bs")


def joint_by_account(sums: DataFrame, account: str, block: str, draws: int = 0, seed: int = 1) -> DataFrame:
    """Residual sums by draw, account and rate; draw 0 is all blocks once, the others weigh blocks by Poisson(1)."""
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    drawn = drawn.withColumn("_k", F.when(F.col("draw") == 0, 1).otherwise(poisson_weight(seed, account, block, "draw")))
    of = lambda c: F.sum(F.col("_k") * F.col(c)).alias(c)
    each = drawn.groupBy("draw", account, "g", "log_rate").agg(*map(of, ("n", "s", "q", "bn", "bs")))
    w = W.partitionBy("draw", account)
    each = each.withColumns({"_bn": F.sum("bn").over(w), "_l": F.sum("bs").over(w) / F.nullif(F.sum("bn").over(w), F.lit(0))}).filter("g is not null and _bn > 0")
    shifted = {"q": F.col("q") - 2 * F.col("_l") * F.col("s") + F.col("n") * F.col("_l") * F.col("_l"), "s": F.col("s") - F.col("n") * F.col("_l")}
    return each.withColumns(shifted).select("draw", account, "g", "log_rate", "n", "s", "q")


def joint_best(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key: the rate of least squared residuals, between grid points by a parabola, and the log change there."""
    w = W.partitionBy(*by).orderBy("g")
    fit = sums.groupBy(*by, "g", "log_rate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).filter("n > 0").withColumns({"ss": F.col("q") - F.col("s") * F.col("s") / F.col("n"), "m": F.col("s") / F.col("n")})
    near = {f"{c}{k}": F.lag(c, d).over(w) for c in ("ss", "m", "log_rate") for k, d in (("_a", 1), ("_b", -1))}
    top = fit.withColumns(near).groupBy(*by).agg(F.min_by(F.struct("n", "ss", "m", "log_rate", *near), F.struct("ss", "g")).alias("_r")).select(*by, "_r.*")
    bend = F.col("ss_a") - 2 * F.col("ss") + F.col("ss_b")
    shift = F.when(bend > 0, (F.col("ss_a") - F.col("ss_b")) / bend / 2).otherwise(0.0)
    return top.withColumn("_d", F.coalesce(shift, F.lit(0.0))).select(
        *by, "n", F.exp(F.col("log_rate") + F.col("_d") * F.coalesce(F.col("log_rate_b") - F.col("log_rate"), F.lit(0.0))).alias("rate"),
        (F.col("m") + F.col("_d") * F.coalesce((F.col("m_b") - F.col("m_a")) / 2, F.lit(0.0))).alias("log_change"), F.sqrt(F.greatest(F.col("ss"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("spread"),
    )


def joint_interval(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Draw 0's fit with the 95 % interval of the other draws."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    drawn = F.when(F.col("draw") > 0, F.col("rate"))
    moved = F.when(F.col("draw") > 0, F.col("log_change"))
    own = lambda c: F.max(F.when(F.col("draw") == 0, F.col(c))).alias(c)
    out = fits.withColumns({"_r": drawn, "_m": moved}).groupBy(*by).agg(own("n"), own("rate"), own("log_change"), own("spread"), q("_r").alias("_rq"), q("_m").alias("_mq"))
    return out.select(*by, "n", "rate", F.col("_rq")[0].alias("rate_lo"), F.col("_rq")[1].alias("rate_hi"), "log_change", F.col("_mq")[0].alias("change_lo"), F.col("_mq")[1].alias("change_hi"), "spread")


def separable(interval: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether the rate is told apart from the change: a narrow interval off the bounds, and enough stretches that mix new and known work."""
    share = F.col("new") / F.nullif(F.col("known") + F.col("new"), F.lit(0.0))
    mixed = rows.filter((F.col("side") == "after") & share.between(*MIXED_SHARE)).agg(F.count("*").alias("n_mixed"))
    lo, hi = RATE_BOUNDS
    pinned = (F.col("rate_lo") > lo * 1.05) & (F.col("rate_hi") < hi / 1.05) & (F.col("rate_hi") <= SEPARABLE_SPAN * F.col("rate_lo"))
    return interval.crossJoin(F.broadcast(mixed)).withColumns({"pinned": F.coalesce(pinned, F.lit(False)), "separable": F.coalesce(pinned, F.lit(False)) & (F.col("n_mixed") >= LEAST_MIXED)})


def joint_without(by_account: DataFrame, account: str) -> DataFrame:
    """The fit without each account, by subtracting its sums; ``holds`` where the interval keeps the whole fit's direction."""
    whole = by_account.groupBy("draw", "g").agg(*(F.sum(c).alias(f"_{c}") for c in "nsq"))
    rest = by_account.join(F.broadcast(whole), ["draw", "g"]).select("draw", account, "g", "log_rate", *((F.col(f"_{c}") - F.col(c)).alias(c) for c in "nsq"))
    left = joint_interval(joint_best(rest, ["draw", account]), [account])
    full = joint_best(by_account.filter("draw = 0"), ["draw"]).select(F.col("log_change").alias("whole_change"))
    holds = F.when(F.col("whole_change") > 0, F.col("change_lo") > 0).when(F.col("whole_change") < 0, F.col("change_hi") < 0).otherwise(False)
    return left.crossJoin(F.broadcast(full)).withColumn("holds", F.coalesce(holds, F.lit(False)))


def adopted(rates: DataFrame, fit: DataFrame, family: str, base_rate: float) -> DataFrame:
    """The rate table with a family's joint fit: the fitted rate where it separates, else its list ratio where a before side exists, else as it was.

    ``rates`` is (family, rate, list_ratio, source); ``fit`` is one row of :func:`separable`, none where no account has a before side.
    """
    one = fit.select("rate", "separable").limit(1).withColumnsRenamed({"rate": "_fit"}).withColumn("family", F.lit(family))
    new = F.when(F.col("separable"), F.col("_fit") * base_rate).when(F.col("_fit").isNotNull() & F.col("list_ratio").isNotNull(), F.col("list_ratio"))
    source = F.when(F.col("separable"), "joint fit").when(F.col("_fit").isNotNull() & F.col("list_ratio").isNotNull(), "list price")
    return rates.join(F.broadcast(one), "family", "left").select("family", F.coalesce(new, F.col("rate")).alias("rate"), "list_ratio", F.coalesce(source, F.col("source")).alias("source"))


# --- levels that are profiled out ------------------------------------------------------------------


def factor_within(df: DataFrame, levels: Sequence[str], y: str, x: str, beside: Sequence[str] = (), rounds: int = 40, least_rows: int = 20, least_sd: float = 0.05) -> DataFrame:
    """Quasi-Poisson factor exp(b) of ``x`` with a free level for each group of ``levels``: one row, none below the gates.

    ``beside`` are a few more regressors, such as dummies of regimes. A group's level follows from its sums, so
    Newton's steps need two aggregations each and no column a group. Groups of one row, of one value of ``x``
    or without counts tell nothing and are left out. Gates: rows, and the spread of ``x`` inside groups.
    """
    spark = df.sparkSession
    schema = "factor double, lo double, hi double, dispersion double, n long, levels long"
    told = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*levels).agg(F.count("*").alias("_n"), F.min(x).alias("_a"), F.max(x).alias("_b"), F.sum(y).alias("_y")).filter("_n > 1 and _b > _a and _y > 0")
    names = [f"_x{i}" for i in range(1 + len(beside))]
    rows = df.join(told.select(*levels), list(levels)).select(*levels, F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(k) for k, c in zip(names, (x, *beside), strict=True))).na.drop(subset=["_y", *names]).persist()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    try:
        mean = F.avg("_x0").over(W.partitionBy(*levels))
        n, groups, spread = rows.withColumn("_c", F.col("_x0") - mean).agg(F.count("*"), F.count_distinct(*levels), F.sqrt(F.avg(F.col("_c") * F.col("_c")))).first()
        if n < least_rows or (spread or 0.0) < least_sd:
            return spark.createDataFrame([], schema)
        b, info = np.zeros(len(names)), np.zeros((len(names),) * 2)
        power = lambda: F.exp(sum((F.lit(float(v)) * F.col(k) for v, k in zip(b, names, strict=True)), F.lit(0.0)))
        for _ in range(rounds):
            e = power()
            g = rows.groupBy(*levels).agg(F.sum("_y").alias("y"), F.sum(e).alias("e"), *(F.sum(F.col("_y") * F.col(k)).alias(f"y{i}") for i, k in enumerate(names)), *(F.sum(e * F.col(k)).alias(f"e{i}") for i, k in enumerate(names)), *(F.sum(e * F.col(names[i]) * F.col(names[j])).alias(f"e{i}_{j}") for i, j in pairs))
            got = g.agg(*(F.sum(F.col(f"y{i}") - F.col("y") * F.col(f"e{i}") / F.col("e")) for i in range(len(names))), *(F.sum(F.col("y") * (F.col(f"e{i}_{j}") / F.col("e") - F.col(f"e{i}") * F.col(f"e{j}") / F.col("e") / F.col("e"))) for i, j in pairs)).first()
            for (i, j), v in zip(pairs, got[len(names) :], strict=True):
                info[i, j] = info[j, i] = v
            step = np.clip(np.linalg.lstsq(info, np.array(got[: len(names)]), rcond=1e-12)[0], -2, 2)
            b = b + step
            if np.abs(step).max() < 1e-10:
                break
        mu = power()
        level = rows.groupBy(*levels).agg((F.sum("_y") / F.sum(mu)).alias("_level"))
        fitted = F.col("_level") * mu
        pearson = rows.join(level, list(levels)).agg(F.sum((F.col("_y") - fitted) * (F.col("_y") - fitted) / fitted)).first()[0]
        phi = pearson / max(n - groups - len(names), 1)
        half = 1.96 * float(phi * np.linalg.pinv(info)[0, 0]) ** 0.5
        return spark.createDataFrame([(float(np.exp(b[0])), float(np.exp(b[0] - half)), float(np.exp(b[0] + half)), phi, n, groups)], schema)
    finally:
        rows.unpersist()
