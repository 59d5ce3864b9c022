"""All workload areas together."""

from __future__ import annotations

from importlib import import_module

from tallyman.workload.registry import Query, Workload

AREAS = ("packing", "ranges", "files", "catalogs", "sync", "search", "streams")


def _areas() -> list[Workload]:
    return [import_module(f"tallyman.workload.{name}").work for name in AREAS]


def queries() -> dict[str, Query]:
    return {name: fn for area in _areas() for name, fn in area.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.sql.items()}
