"""Registered queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from mesalith.plans import io_queries, mesh_queries, raster_queries, tile_queries  # noqa: E402, F401  they register themselves
