"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib

from kgspark.plans import registry

MODULES = ("links", "graph", "health", "metadata", "search", "retrieval", "index", "crossvault", "edits", "streams", "extras", "flows")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"kgspark.plans.{name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
