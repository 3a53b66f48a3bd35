"""Detections as written by a detector: one row per box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstlens.schemas import DETECTIONS


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with a fixed schema; filters on ``bbox_confidence`` reach the files."""
    return spark.read.schema(DETECTIONS).parquet(path)
