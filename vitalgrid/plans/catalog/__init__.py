"""Registered queries: one per operator, with its check in SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.plans import oracle
from vitalgrid.plans.views import Views


@dataclass
class Entry:
    name: str
    columns: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return typed(self.build(Views(spark, folder)), self.columns)


ENTRIES: dict[str, Entry] = {}


def typed(df: DataFrame, spec: str) -> DataFrame:
    """Named output columns: integers as bigint, doubles rounded to 6 places."""
    cols = []
    for name, kind in oracle.columns(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "d":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "s":
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def query(name: str, columns: str, uses: str = "", sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a query builder together with its SQL check."""

    def register(fn: Callable[[Views], DataFrame]):
        text = None if sql is None else oracle.statement(columns, uses, sql, extra)
        ENTRIES[name] = Entry(name, columns, fn, text)
        return fn

    return register


def load() -> dict[str, Entry]:
    for module in ("sources", "rows", "normalize", "rolling", "resample", "features", "spectral", "intervals",
                   "windows", "augment", "metrics", "losses", "streaming", "plans"):
        importlib.import_module(f"vitalgrid.plans.catalog.{module}")
    return ENTRIES
