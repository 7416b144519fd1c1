"""Are readings that are known to whole percents explained by constant rates at all.

The least extra slack t, beyond each row's own, with which some non-negative rates fit every row of a
group, is a linear programme of few variables and two rows a reading. Its dual has one row a variable, so
a simplex over it keeps a basis of that size and works on whole columns of rows at once. A group of
any size is cut into parts: a part offers the rows its own optimum rests on and the rows that break the
group's present one most, until no row breaks it. So no task holds a group's rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.cut import written

TOLERANCE = 1e-9


def least_slack(x: np.ndarray, y: np.ndarray, slack: np.ndarray) -> tuple[float, np.ndarray]:
    """min t subject to |x b - y| <= slack + t, b >= 0, t >= 0: (t, b)."""
    n, m = x.shape
    scale = np.maximum(np.abs(x).max(0, initial=0.0), 1e-300)
    a = np.vstack([np.column_stack([x / scale, -np.ones(n)]), np.column_stack([-x / scale, -np.ones(n)])])
    bound = np.concatenate([y + slack, slack - y])
    cost = np.concatenate([np.zeros(m), [1.0]])
    rows, columns = m + 1, 2 * n
    # dual: max -bound u, -a' u <= cost, u >= 0; u = 0 is a start
    table = np.column_stack([-a.T, np.eye(rows), cost])
    goal = np.concatenate([bound, np.zeros(rows), [0.0]])
    basis = np.arange(columns, columns + rows)
    for turn in range(200 * (rows + 10)):
        if not (goal[:-1] < -TOLERANCE).any():
            break
        # the steepest column at first; the lowest one later, which cannot cycle
        enter = int(np.argmin(goal[:-1])) if turn < 20 * rows else int(np.flatnonzero(goal[:-1] < -TOLERANCE)[0])
        column = table[:, enter]
        up = column > TOLERANCE
        if not up.any():
            raise ArithmeticError("the programme has no bounded optimum")
        ratio = np.where(up, table[:, -1] / np.where(up, column, 1.0), np.inf)
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        leave = int(ties[np.argmin(basis[ties])])
        table[leave] /= table[leave, enter]
        for r in range(rows):
            if r != leave:
                table[r] -= table[r, enter] * table[leave]
        goal = goal - goal[enter] * table[leave]
        basis[leave] = enter
    else:
        raise ArithmeticError("the simplex did not end")
    z = goal[columns : columns + rows]
    return float(max(z[m], 0.0)), np.maximum(z[:m], 0.0) / scale


def excess(x: np.ndarray, y: np.ndarray, slack: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much slack each row needs beyond its own at rates b."""
    return np.abs(x @ b - y) - slack


def rounding_slack(df: DataFrame, by: Sequence[str], y: str, slack: str, x: Sequence[str], part_rows: int = 20_000, most_rounds: int = 60) -> DataFrame:
    """One row a group: rows, the least extra slack, and rates that reach it.

    Each round is one pass over the rows with their group's present rates, and one small fit a group.
    Rows without a movement or a slack are left out; a missing column counts as 0.
    """
    by, xs = list(by), [f"x{k}" for k in range(len(x))]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = [f"{c} {types[c]}" for c in by]
    columns = [*by, "y", "slack", *xs]
    design = ", ".join([*keys, *[f"{c} double" for c in columns[len(by) :]]])
    fitted = ", ".join([*keys, "extra double", "rates array<double>"])
    rows = df.select(*by, F.col(y).cast("double").alias("y"), F.col(slack).cast("double").alias("slack"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(x)]).filter("y is not null and slack is not null")
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    parts = -(-(counts.agg(F.max("n")).first()[0] or 1) // part_rows)
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(parts))), "readings")

    def arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return f[xs].to_numpy(float), f["y"].to_numpy(float), f["slack"].to_numpy(float)

    def resting(f: pd.DataFrame) -> pd.DataFrame:
        """The rows that a part's optimum rests on: those that need all of its slack."""
        f = f[columns].drop_duplicates()
        t, b = least_slack(*arrays(f))
        need = excess(*arrays(f), b)
        return f[need >= t - 1e-7 * max(1.0, t)] if t > 0 else f.iloc[[int(np.argmax(need))]]

    def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        t, b = least_slack(*arrays(f))
        return pd.DataFrame([(*key, t, b.tolist())], columns=[*by, "extra", "rates"])

    def broken(f: pd.DataFrame) -> pd.DataFrame:
        """A part's rows that break the group's fit most, one on each side."""
        a, v, s = arrays(f)
        off, t = a @ np.array(f["rates"].iloc[0], float) - v, float(f["extra"].iloc[0])
        picks = sorted({int(np.argmax(off - s)), int(np.argmax(-off - s))})
        return f.iloc[[k for k in picks if abs(off[k]) - s[k] > t + 1e-7 * max(1.0, t)]][columns]

    active = written(rows.groupBy(*by, "part").applyInPandas(resting, design), "active")
    for _ in range(most_rounds):
        fits = written(active.groupBy(*by).applyInPandas(fit, fitted), "fits")
        new = written(rows.join(fits, by).groupBy(*by, "part").applyInPandas(broken, design), "broken")
        if new.isEmpty():
            return counts.join(fits, by).select(*by, "n", "extra", *[F.col("rates")[k].alias(f"rate_{c}") for k, c in enumerate(x)])
        active = active.unionByName(new)
    raise ArithmeticError("rows still break the fit")
