"""Every query of the library, by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import base, figures, files, joins, metering, relational, reports, runs, solvers, statistics, valuation  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def covers() -> dict[str, tuple[str, ...]]:
    return dict(base.COVERS)
