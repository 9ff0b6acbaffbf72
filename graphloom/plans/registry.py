"""The queries of the engine and their SQL. Modules of this folder add to it by `query`."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "grf-06"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a plan, a function of Tables, under the name of its operator, with SQL for the same rows."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return plan

    return add


for _module in ("graph", "links", "retrieval", "telemetry", "memory", "scalars", "evaluation", "lineage", "jobs", "symbols", "recall", "rules", "analysis", "stores", "queue"):
    import_module(f"graphloom.plans.{_module}")
