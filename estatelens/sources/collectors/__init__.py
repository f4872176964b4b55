"""Query packs of three engines as collectors over landed catalog tables."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame

from ...operators.rules import in_scope
from . import mssql, oracle, postgres
from .base import Catalog, Collector, conform

COLLECTORS: dict[str, Collector] = {c.query_id: c for m in (mssql, oracle, postgres) for c in m.COLLECTORS}


def collect(query_id: str, raw: Mapping[str, DataFrame], by: list[str] = (), scope: DataFrame | None = None) -> DataFrame:
    """Run one collector; a scope (schema_name) keeps only declared schemas, on the column the collector names."""
    col = COLLECTORS[query_id]
    df = col.run(Catalog(raw, list(by)))
    if scope is None or col.scope_column is None:
        return df
    return in_scope(df, scope.withColumnRenamed("schema_name", col.scope_column), [col.scope_column])


__all__ = ["COLLECTORS", "Catalog", "Collector", "collect", "conform"]
