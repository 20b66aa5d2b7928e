"""Queries that the package registers, by operator, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .testviews import for_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("text", "html", "papers", "claims", "telemetry", "catalog", "sources", "streams")


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL over the views of ``testviews``."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = for_duckdb(sql)
        return f

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"litspark.queries.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["rul_12_run_campaigns"](spark, sf_dir)
