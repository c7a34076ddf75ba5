"""Every query of the library by name, with its DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("market_queries", "text_queries", "graph_queries", "source_queries", "serving_queries", "story_queries")


def _modules():
    return [importlib.import_module(f"narrascope.plans.{name}") for name in MODULES]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.plans.market_queries import basket_vs_universe

    return basket_vs_universe(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for mod in _modules() for name, f in mod.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from narrascope.plans.story_sql import SQL

    return {name: sql for mod in _modules() for name, sql in getattr(mod, "SQL", {}).items()} | SQL
