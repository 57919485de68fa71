"""Named queries over a warehouse folder, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(spark, folder)`` under ``name``, with the SQL that gives the same rows."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def as_double(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def joined(name: str, separator: str = "|") -> Column:
    return F.array_join(name, separator).alias(name)


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
