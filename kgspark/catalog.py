"""What there is: the queries by group, in pages."""

from __future__ import annotations

from kgspark.plans import catalogue


def entries() -> list[dict]:
    found, sql = catalogue.queries(), catalogue.oracle_sql()
    return [{"name": n, "group": f.__module__.rsplit(".", 1)[-1], "about": (f.__doc__ or "").strip().split("\n")[0], "has_sql": n in sql} for n, f in sorted(found.items())]


def discover(limit: int = 20, offset: int = 0) -> dict:
    every = entries()
    page = every[offset : offset + limit]
    groups: dict[str, int] = {}
    for e in every:
        groups[e["group"]] = groups.get(e["group"], 0) + 1
    return {"entries": page, "total": len(every), "has_more": offset + len(page) < len(every), "groups": groups}
