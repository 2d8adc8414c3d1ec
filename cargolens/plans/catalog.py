"""Registry of runnable queries: one entry per operator ID of the survey.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables in ``sf_dir``; its oracle SQL is registered beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB oracle (CTEs from ``sqlkit`` are added)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Importing the modules registers their queries.
    from cargolens.plans import (  # noqa: F401
        q_carbon, q_choice, q_composite, q_io, q_lanes, q_ml, q_risk, q_stream, q_text, q_vendors,
    )
    return dict(QUERIES)


def load_oracle() -> dict[str, str]:
    from cargolens.plans.sqlkit import with_ctes

    load_all()
    return {k: with_ctes(v) for k, v in ORACLE.items()}
