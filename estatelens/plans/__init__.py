"""Operators bound to the given tables, and the SQL each result is checked against."""

from importlib import import_module

MODULES = ["profiling_plans", "relationship_plans", "catalog_plans", "history_plans", "decision_plans", "collector_plans", "stream_plans", "sink_plans"]


def _registries():
    return [import_module(f"{__name__}.{m}").R for m in MODULES]


def all_queries() -> dict:
    return {k: v for r in _registries() for k, v in r.queries.items()}


def all_oracles() -> dict:
    return {k: v for r in _registries() for k, v in r.oracles.items()}
