"""Registered queries: one Spark job and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round({expr}, {digits}) + 0.0)"
