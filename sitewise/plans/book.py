"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.plans.inputs import CTE, NEEDS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def sql(needs: str, body: str, **extra: str) -> str:
    """`body` behind the named input views, what they need, and the extra views in order, each made once."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    views = {n: CTE[n] for n in order} | extra
    head = ",\n".join(f"{n} as materialized (\n{text.strip()}\n)" for n, text in views.items())
    return f"with {head}\n{body.strip()}" if views else body.strip()


def r6(c: str | Column) -> Column:
    """Six decimals and no negative zero. Engines add floats in different orders, so a nudge below
    the last digit keeps exact halves from falling to either side."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6) + F.lit(0.0)


def rs(expression: str) -> str:
    """The same rounding in SQL."""
    return f"round(({expression}) + 1e-9, 6) + 0.0"
