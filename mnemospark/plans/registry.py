"""Registered queries: a Spark plan and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import ORACLE_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None, views: str = ""):
    """Register the decorated plan under its name. ``operators``: inventory ids it covers;
    ``views``: fixture views its SQL reads, put before it as common table expressions."""

    def add(plan: Callable[[Tables], DataFrame]):
        name = plan.__name__
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        OPERATORS[name] = operators
        if sql:
            ctes = ", ".join(f"{v} AS ({ORACLE_VIEWS[v]})" for v in views.split())
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("WITH RECURSIVE ", "WITH ").strip()
            if ctes and body.startswith("WITH "):
                body = f"WITH {recursive}{ctes}, {body[5:]}"
            elif ctes:
                body = f"WITH {ctes} {body}"
            elif recursive:
                body = f"WITH {recursive}{body[5:]}"
            ORACLE_SQL[name] = body
        return plan

    return add
