"""All queries of the trajectory engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import benchmark, relational, source_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**benchmark.QUERIES, **relational.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {**benchmark.ORACLES, **relational.ORACLES, **source_queries.ORACLES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: positions of ten vehicles at ten instants."""
    return QUERIES["q3"](spark, sf_dir)
