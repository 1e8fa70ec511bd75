"""Registry of named queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog.views import Views
from tidemark.catalog.views_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix the body with the view definitions it needs, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head},\n{stripped[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function of the shared views. ``sql`` may use the same views by name."""

    def register(fn: Callable[..., DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
