"""All registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazmill.plans import graph_queries, label_queries, report_queries, search_queries, stream_queries, text_queries  # noqa: F401
from hazmill.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["analyze"](spark, sf_dir)
