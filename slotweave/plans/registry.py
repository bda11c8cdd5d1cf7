"""The query catalogue: name -> Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from slotweave.plans.views import Tables

_MODULES = ["texts", "splits", "sources", "generation", "retrieval", "release"]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


_QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = Query(fn.__name__, fn, sql)
        return fn

    return register


def catalogue() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"slotweave.plans.catalogue.{module}")
    return dict(_QUERIES)
