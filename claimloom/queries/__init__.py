"""One query for each operator over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.sources.spread import spread

#: Tables of texts, of which a row costs enough to be worth moving where a scan has few tasks.
TEXTS = {"documents", "pages", "conversations"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table loader ``t(name) -> DataFrame``; ``sql`` is its equivalent, if SQL can express it."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def load(table: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                return spread(df) if table in TEXTS else df

            return f(load)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


for _module in ("sources", "cleaning", "urls", "grading", "evidence", "review", "entities", "databases", "snapshots", "plans", "modules", "graph", "runs", "benchmark", "retrieval", "pages", "streaming"):
    try:
        importlib.import_module(f"{__name__}.{_module}")
    except ModuleNotFoundError as e:
        if e.name != f"{__name__}.{_module}":
            raise
