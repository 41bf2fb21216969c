"""Registry of the named queries and of the SQL each of them is checked against."""

from __future__ import annotations

from collections.abc import Callable

from panelspark.functions.expr import rounded
from panelspark.plans.fixtures import duck_ctes
from panelspark.plans.shared_sql import SHARED

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", digits: int = 6, ctes: dict[str, str] | None = None):
    """Register a function of (spark, sf_dir); its floating columns are rounded to ``digits``.

    ``sql`` is the DuckDB text over the shared views named in ``views``; without
    it only the rows are looked at.
    """
    def keep(fn: Callable) -> Callable:
        def run(spark, sf_dir):
            return rounded(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            known = {**SHARED, **(ctes or {})}
            ORACLES[name] = duck_ctes([*views.split(), *(ctes or {})], known) + sql
        return fn
    return keep


def r(columns: str, digits: int = 6, prefix: str = "") -> str:
    """SQL list that rounds each named column under its own name."""
    return ", ".join(f"round({prefix}{c}, {digits}) + 0.0 AS {c}" for c in columns.split())


def rx(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"
