"""Registered queries and, where SQL can say the same, their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """A named SQL fragment and the fragments it reads."""
    CTES[name] = (body, needs)


def with_ctes(body: str, *needs: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in CTES[name][1]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order) + "\n" + body


def query(name: str, sql: str | None = None, *needs: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` with the fragments in ``needs`` is its twin."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *needs, recursive=recursive)
        return fn

    return register
