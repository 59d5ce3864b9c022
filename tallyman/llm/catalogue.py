"""The operators' queries over the given tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from importlib import import_module

from tallyman.workload.registry import Query, Workload

MODULES = (
    "main_text_queries",
    "host_rule_queries",
    "archive_queries",
    "vector_queries",
    "mixing_queries",
    "sharding_queries",
    "packing_queries",
    "quality_queries",
    "near_dup_queries",
    "suffix_queries",
    "decontamination_queries",
    "whitening_queries",
    "conversation_queries",
)


def _works() -> list[Workload]:
    return [import_module(f"tallyman.llm.{name}").work for name in MODULES]


def queries() -> dict[str, Query]:
    return {name: fn for work in _works() for name, fn in work.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for work in _works() for name, sql in work.sql.items()}
