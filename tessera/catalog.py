"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame computed
from the given tables (or data Spark derived from them). The oracle SQL runs
on the same tables registered as DuckDB views.
"""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = (fn, oracle)
        return fn
    return deco


def _load():
    # importing the modules registers their queries
    from .plans import catalog_data, catalog_requests, catalog_vectors, catalog_images, catalog_stream  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _QUERIES.items() if v[1] is not None}
