"""Names of queries with their DataFrame function and SQL."""

from __future__ import annotations

from collections.abc import Callable

_FOUND: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: register ``fn(spark, sf_dir)`` as query ``name``."""

    def put(fn: Callable) -> Callable:
        if name in _FOUND:
            raise ValueError(f"query {name} is registered twice")
        _FOUND[name] = (fn, sql)
        return fn

    return put


def queries() -> dict[str, Callable]:
    return {k: fn for k, (fn, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}


from . import metric_queries  # noqa: E402, F401
from . import cell_queries  # noqa: E402, F401
from . import catalog_queries, layout_queries, training_queries  # noqa: E402, F401
