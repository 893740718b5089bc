"""The library's functions in SQL: register_functions(spark) makes the text functions callable by name.

Scalar functions are SQL functions whose bodies are the columns' own expressions, so Catalyst inlines them and no Python worker runs. Table
functions that pack greedily are Python ones over a partitioned, ordered table argument.
"""

from __future__ import annotations

import inspect
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text

#: parameters that aren't strings
TYPES = {"year": "INT", "cost": "DOUBLE", "ms": "DOUBLE", "tokens": "ARRAY<STRING>", "authors": "ARRAY<STRING>", "names": "ARRAY<STRING>", "cells": "ARRAY<STRING>", "rows": "ARRAY<ARRAY<STRING>>"}
OPERATORS = r"<=>|<=|>=|=|<|>|\+|-|\*|/|%|!|\band|\bor|\bin|\bnot"


def quoted_calls(sql: str) -> str:
    """sql with the names of operators that are written as functions in backticks; strings stay as they are."""
    parts = re.split(r"('(?:\\.|[^'\\])*')", sql)
    return "".join(p if i % 2 else re.sub(rf"(?<![\w`<>=])({OPERATORS})\(", r"`\1`(", p) for i, p in enumerate(parts))


def scalar_functions() -> dict[str, tuple[list[str], object]]:
    """Name, parameters and function of every text function of columns alone."""
    found = {}
    for name, f in inspect.getmembers(text, inspect.isfunction):
        if f.__module__ != text.__name__ or name.startswith("_"):
            continue
        parameters = [p for p in inspect.signature(f).parameters.values() if p.default is p.empty]
        if parameters and all(p.annotation == "Column" and p.kind is p.POSITIONAL_OR_KEYWORD for p in parameters):
            found[name] = [p.name for p in parameters], f
    return found


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers every function for the session, under prefix and its own name; the names."""
    from ..operators.section_chunks import SectionChunks, returned

    names = []
    for name, (parameters, f) in scalar_functions().items():
        body = quoted_calls(f(*(F.col(p) for p in parameters))._jc.node().sql())
        takes = ", ".join(f"{p} {TYPES.get(p, 'STRING')}" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURN {body}")
        names.append(prefix + name)
    spark.udtf.register(f"{prefix}section_chunks", F.udtf(SectionChunks, returnType=returned("BIGINT")))
    return [*names, f"{prefix}section_chunks"]
