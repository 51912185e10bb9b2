"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import columns, composed, jobs, pages, resolve


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {**columns.queries(), **jobs.QUERIES, **composed.QUERIES, **pages.QUERIES, **resolve.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads by detected network."""
    return queries()["d01_affiliate_network"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, (made, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
