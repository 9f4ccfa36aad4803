"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.fixtures import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

_MODULES = (
    "suite.sources", "suite.text", "suite.urls", "suite.html", "suite.filters", "suite.lexicon",
    "suite.joins", "suite.orders", "suite.sites", "suite.dedup", "suite.categories",
    "suite.matching", "suite.sinks", "suite.plans", "suite.streams",
)


def query(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` together with its oracle SQL."""

    def register(fn):
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = with_views(oracle)
        return fn

    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(module)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {key: bind(fn) for key, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    load()
    return dict(_ORACLES)
