"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spagyric.plans import data_quality, record_queries, text_queries

MODULES = [data_quality, text_queries, record_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return record_queries.melting_range_by_brand(spark, d)
