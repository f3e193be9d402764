"""The catalogue: a key's Spark plan and its SQL (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its own name, or another."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        QUERIES[key] = plan
        if sql is not None:
            SQL[key] = sql
        return plan

    return add
