"""Every query of the library's own operators, with its DuckDB SQL.

A query is a function of Tables; @query registers it under its name together with the SQL that gives the same
rows. Names in braces in the SQL are the model's views, which the SQL then begins with.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .model import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, views: str) -> str:
    """sql behind the definitions of the views it names and of those they need, in the model's order."""
    wanted, todo = set(), views.split()
    while todo:
        v = todo.pop()
        if v not in wanted:
            wanted.add(v)
            todo += VIEWS[v][0].split()
    ctes = [f"{v} AS MATERIALIZED ({VIEWS[v][1]})" for v in VIEWS if v in wanted]
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return head + ",\n".join(ctes) + ",\n" + body[len(start) :]
    return head + ",\n".join(ctes) + "\n" + body


def query(sql: str | None = None, views: str = "", name: str | None = None):
    """Registers a query, under its own name or another."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        key = name or f.__name__
        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_views(sql, views)
        return f

    return register


def load() -> None:
    """Imports every module of queries."""
    for name in ("scans", "text", "joins", "aggregates", "graph", "html", "retrieval", "streams"):
        importlib.import_module(f"{__package__}.{name}")
