"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus an optional
DuckDB oracle text over the shared tables.

Oracle texts may reference the fixture views (``catalog``, ``predictions`` ...);
``oracle_sql`` inlines them as CTEs so DuckDB only needs the base tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.tables import VIEWS, view_sql_for_duckdb

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, ids: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SURVEY_IDS[name] = ids
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _uses(sql: str, view: str) -> bool:
    return re.search(rf"\b{view}\b", sql) is not None


def inline_views(sql: str) -> str:
    ctes = [f"{v} AS ({view_sql_for_duckdb(v).strip()})" for v in VIEWS if _uses(sql, v)]
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
