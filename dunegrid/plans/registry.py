"""Query registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: tuple[str, ...] = field(default_factory=tuple)


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB oracle (None for seed-dependent or iterative
    operators, which get a rows-only check); ``ops`` lists the inventory rows
    the query exercises.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(ops))
        return fn
    return deco


def get(name: str) -> Query:
    return QUERIES[name]


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    """Assemble ``WITH a AS (...), b AS (...) body``."""
    parts = ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in ctes)
    return f"WITH {parts}\n{body.strip()}"
