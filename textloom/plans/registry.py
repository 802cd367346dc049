"""All registered queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import index_queries, more_queries, store_queries  # noqa: F401 (register their queries)
from . import queries as registered


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: fused ranks of hybrid retrieval."""
    return registered.rrf_fusion(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
