"""All registered queries on the reference tables, with their DuckDB oracles. Every query covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


from . import audit_queries, bag_queries, effect_queries, file_queries, graph_queries, order_queries, policy_queries, register_queries, scalar_queries, source_queries  # noqa: E402, F401
