"""Registry of bound queries: each operator run on the test bindings, with the
independent DuckDB oracle that states the source application's semantics.

A bound query is ``fn(bound) -> DataFrame`` where ``bound`` is a
:class:`touchline.plans.bindings.Bound`. Its oracle is SQL over the binding
views; :func:`touchline.plans.bindings.duckdb_sql` inlines the views it uses.
Queries without an oracle (nested or non-SQL results) are checked in pytest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.plans.bindings import Bound, duckdb_sql

QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound_query(name: str, oracle: str | None = None):
    """Register ``fn(bound) -> DataFrame`` under ``name`` with an optional oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from touchline.plans import (  # noqa: F401
        bound_documents, bound_merge, bound_present, bound_scope, bound_serve, bound_sources, bound_validate)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def runner(fn):
        return lambda spark, sf_dir: fn(Bound(spark, sf_dir))

    return {name: runner(fn) for name, fn in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    _load_all()
    return {name: duckdb_sql(sql) for name, sql in ORACLES.items()}
