"""Registration of queries with their oracle SQL."""

from __future__ import annotations


def registrar():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def keep(fn):
            queries[name] = fn
            if sql:
                oracles[name] = sql
            return fn

        return keep

    return queries, oracles, query
