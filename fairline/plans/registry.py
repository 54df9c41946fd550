"""Named queries with, where SQL can say the same thing, their SQL twin.

A query is a function ``(spark, sf_dir) -> DataFrame``. The SQL twins are written against
the star-schema views and share the common table expressions in ``CTES``; only those a
query names (directly or through another) are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"common table {name} is already defined")
    CTES[name] = sql.strip()


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\bx_[a-z0-9_]+\b", text))
        for name in [n for n in CTES if n in words]:
            if name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_tables(sql: str) -> str:
    """The SQL with the common tables it names written in front of it."""
    names = _needed(sql)
    if not names:
        return sql.strip()
    parts = []
    for name in names:
        head = " AS MATERIALIZED " if CTES[name].startswith("--m") else " AS "
        parts.append(f"{name}{head}(\n{CTES[name].removeprefix('--m').strip()}\n)")
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory rows it exercises."""
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = Query(name, build, sql, tuple(covers.split()))
        return build
    return add


def load_all() -> dict[str, Query]:
    from fairline.plans import (  # noqa: F401  (import registers the queries)
        queries_backtest,
        queries_card, queries_certificates, queries_ledger, queries_loading, queries_model,
        queries_pricing, queries_scoring)
    return QUERIES


def queries() -> dict[str, Build]:
    return {name: q.build for name, q in load_all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(q.sql) for name, q in load_all().items() if q.sql}
