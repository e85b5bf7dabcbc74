"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquesina.plans.bindings import Bound, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(bound tables)`` under ``name``, with the SQL of its check if there is one."""
    def register(build: Callable[[Bound], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Bound(spark, folder))
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return build
    return register
