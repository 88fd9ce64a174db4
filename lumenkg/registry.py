"""Every query of the engine beside its SQL: @query("id", sql) registers a callable of (spark, sf_dir)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a stable id; sql is the same query for an independent engine."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def oracle(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _ORACLES[name]


def _load() -> None:
    from lumenkg import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"lumenkg.plans.{module.name}")


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
