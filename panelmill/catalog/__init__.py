"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib

AREAS = ("factors", "cross", "stats", "joins", "portfolio", "data", "review", "workflows", "streams")


def load() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for area in AREAS:
        module = importlib.import_module(f"{__name__}.{area}")
        clash = set(queries) & set(module.QUERIES)
        if clash:
            raise ValueError(f"duplicate queries: {sorted(clash)}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
