"""The registered queries of the core, by module."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["orphan_queries", "graph_queries", "flow_queries", "source_queries"]


def _parts() -> list:
    return [import_module(f"{__name__}.{m}") for m in _MODULES]


def all_queries() -> dict:
    return {k: f for m in _parts() for k, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: s for m in _parts() for k, s in m.SQL.items()}
