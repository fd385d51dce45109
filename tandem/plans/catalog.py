"""All named queries of the library, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import drawn, entity, files, inputs, learned, negatives, registry, retrieval, textual  # noqa: F401  their queries register themselves


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed candidates, scored, ranked, evaluated as recall rate at 1 to 20."""
    return retrieval.recall_rate(spark, sf_dir)
