"""Queries over the driver's tables, by name, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import augment_queries, evaluation_queries, generate_queries, geometry_queries, result_queries, tiling_queries, track_queries

MODULES = (evaluation_queries, tiling_queries, track_queries, augment_queries, generate_queries, result_queries, geometry_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
