"""Queries by name: a Spark plan and, where SQL can express it, the SQL with the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.functions.text import WHITE

MODULES = ("retrieval", "textual", "tables", "shaping", "inventory", "reports")

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def spelled_out(sql: str) -> str:
    """``sql`` with each "strip(x)" as a regular expression that takes off white space of any kind."""
    while (at := sql.find("strip(")) >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        sql = f"{sql[:at]}regexp_replace({sql[at + 6 : end - 1]}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g'){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register the decorated function as query ``name``."""

    def add(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = spelled_out(sql)
        return plan

    return add


def _load() -> None:
    """Import the modules that register queries."""
    for module in MODULES:
        importlib.import_module(f"folioforge.plans.{module}")


def queries() -> dict[str, Plan]:
    _load()
    return _PLANS


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    _load()
    return _PLANS["ag0_aspect_metrics"](spark, directory)
