"""Registry of runnable queries and their SQL statements."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def edge(df: DataFrame) -> DataFrame:
    """Edge types: whole numbers as BIGINT, fractions as DOUBLE, flags as BIGINT 0/1."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "boolean":
            c = c.cast("int").cast("bigint")
        elif kind == "float" or kind.startswith("decimal"):
            c = c.cast("double")
        cols.append(c.alias(name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL (common tables are added)."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, lambda spark, sf: edge(fn(spark, sf)),
                              with_tables(sql) if sql else None)
        return fn
    return wrap


def with_tables(body: str) -> str:
    """Prefix the statement with the common tables it mentions, directly or through others."""
    from .domain import COMMON
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in COMMON.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    parts = [f"{n} AS ({d.strip()})" for n, d in COMMON.items() if n in needed]
    text = body.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + text[len("WITH RECURSIVE"):].lstrip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + text
