"""All registered queries of the offer engine, with the DuckDB SQL of each.

A plan is a function of the views; registering it makes a query of (spark, sf_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.bindings import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a plan under a name, with the body of its oracle."""

    def add(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return plan

    return add


from .plans import load_all  # noqa: E402

load_all()
