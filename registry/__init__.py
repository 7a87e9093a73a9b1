"""Registered queries, each next to the DuckDB SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.session import configure
from foliant.sources.fixtures import SHAPES, SOURCE_TABLES, Tables, shape_sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle when SQL can state it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_shapes(sql)
        return function

    return add


def with_shapes(sql: str) -> str:
    """Put the shapes that ``sql`` names as ``{shape}`` in front of it as CTEs."""
    ctes: dict[str, str] = {}

    def pull(text: str) -> str:
        for name in SHAPES:
            if "{" + name + "}" in text:
                if name not in ctes:
                    ctes[name] = pull(shape_sql(name))
                text = text.replace("{" + name + "}", name)
        for name in SOURCE_TABLES:
            text = text.replace("{" + name + "}", name)
        return text

    body = pull(sql).strip()
    if not ctes:
        return body
    # pull() stores a shape after the shapes it refers to.
    head = ",\n".join(f"{name} AS ({text.strip()})" for name, text in ctes.items())
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(configure(spark), folder))


def load_all() -> None:
    """Import the modules that register queries."""
    for module in ("text", "grounded", "paged", "catalogued", "stateful", "streamed", "stored", "recognised"):
        try:
            importlib.import_module(f"registry.{module}")
        except ModuleNotFoundError as missing:
            if missing.name != f"registry.{module}":
                raise
