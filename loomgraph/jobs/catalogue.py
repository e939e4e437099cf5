"""Every registered query of the graph, retrieval and knowledge operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.views import SQL_VIEWS, Graph

_QUERIES: dict[str, Callable[[Graph], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "", name: str | None = None):
    """Registers a query under its function's name; ``sql`` may use the model's tables and ``ctes``."""

    def add(f: Callable[[Graph], DataFrame]):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = f"WITH RECURSIVE {SQL_VIEWS.strip()}{',' + ctes if ctes else ''}\n{sql}"
        return f

    return add


def _load() -> None:
    from loomgraph.jobs import graph_queries, knowledge_queries, scalar_queries, text_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["impact"](Graph(spark, sf_dir))
