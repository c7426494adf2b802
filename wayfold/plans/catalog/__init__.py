"""The registered queries, one module per family of operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..views import Views, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

FAMILIES = (
    "extracts",
    "files",
    "expressions",
    "linkrules",
    "filters",
    "joins",
    "aggregates",
    "orders",
    "sets",
    "rasters",
    "grids",
    "places",
    "pois",
    "zones",
    "roads",
    "relations",
)


def register(name: str, check: str | None = None):
    """Register `fn(views) -> DataFrame` under `name`, with its checking SQL if there is one."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if check is not None:
            CHECKS[name] = check_sql(check)
        return fn

    return wrap


def rnd(expr: str, digits: int = 4) -> str:
    """SQL text of `functions.maths.round_half_up`."""
    scale = f"{float(10**digits):.1f}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
