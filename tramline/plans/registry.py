"""Queries by name, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.plans.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """`sql` after the definitions of the views that it names."""
    named: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in named and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in named:
                    named.append(name)

    need(sql)
    if not named:
        return sql
    heads = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in named)
    if m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{heads},\n{sql[m.end():]}"
    return f"WITH {heads}\n{sql}"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Views under its name."""

    def register(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[key] = with_views(sql)
        return f

    return register
