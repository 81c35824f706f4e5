"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import queries_cells, queries_fields, queries_models, queries_more, queries_sets, queries_studies, queries_tables
from gridloom.plans.registry import Query


def _all() -> dict[str, Query]:
    return {**queries_cells.REGISTRY.queries, **queries_sets.REGISTRY.queries, **queries_models.REGISTRY.queries, **queries_more.REGISTRY.queries, **queries_fields.REGISTRY.queries, **queries_tables.REGISTRY.queries, **queries_studies.REGISTRY.queries}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, q in _all().items() if (sql := q.oracle())}
