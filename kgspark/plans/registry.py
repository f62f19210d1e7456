"""Queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def mil(x: str) -> str:
    """SQL of x rounded half up to six places, as the queries round."""
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
