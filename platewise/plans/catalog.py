"""Registered queries: one Spark plan per operator of SURVEY §2, each with
its DuckDB oracle (where the operator is expressible in SQL).

Every query reads the driver's tables (through the fixture views, which Spark
derives from ``orders`` / ``customer`` / ``lineitem``), runs over whole tables
and returns a DataFrame without collecting it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platewise.fixtures_sql import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the DuckDB oracle body (fixture views are prepended)."""

    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from platewise.plans import (  # noqa: F401
        q_analysis, q_features, q_import, q_ml, q_reports, q_sources, q_split,
    )


def queries() -> dict[str, Query]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
