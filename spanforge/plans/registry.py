"""The queries of the interval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.plans import chain, dose_queries, enrichment_queries, epistasis_queries, interval_queries, match_queries, report_queries, signal_queries, source_queries

MODULES = (interval_queries, enrichment_queries, dose_queries, signal_queries, epistasis_queries, match_queries, report_queries, source_queries, chain)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["coverage_by_gene"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
