"""Loads every query module and hands out what they registered."""

from __future__ import annotations

from importlib import import_module
from typing import NamedTuple

from bestofk.plans import registry

MODULES = (
    "metric_queries",
    "scoring_queries",
    "source_queries",
    "report_queries",
    "stream_queries",
)


class Catalog(NamedTuple):
    queries: dict[str, registry.Query]
    oracles: dict[str, str]


def load_catalog() -> Catalog:
    for name in MODULES:
        import_module(f"bestofk.plans.{name}")
    return Catalog(registry.QUERIES, registry.ORACLES)
