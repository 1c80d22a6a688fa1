"""The registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import files, inputs, retrieval, tracker, tracking, vocabulary  # noqa: F401  the plans register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every frame the three objects that its visual words score best on."""
    return inputs.QUERIES["r9_retrieve_frames"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(inputs.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(inputs.SQL)
