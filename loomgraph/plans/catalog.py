"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import api_queries, audit_queries, cloud_queries, function_queries, graph_queries, link_queries, contract_queries, flow_queries, lookup_queries, more_queries, observe_queries, source_queries, stream_queries, telemetry_queries  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.impact(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
