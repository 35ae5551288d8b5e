"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULES = ("bar_queries", "label_queries", "strategy_queries", "model_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"barloom.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
