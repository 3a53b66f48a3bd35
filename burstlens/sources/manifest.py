"""Manifest scan: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.schemas import MANIFEST


def manifest_path(path: Column, image_path: Column) -> Column:
    """``path`` unless it is null or empty, else ``image_path`` by the same rule."""
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(image_path, F.lit("")))


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows that name a file, with the one path that counts."""
    named = rows.withColumn("path", manifest_path(F.col("path"), F.col("image_path")))
    return named.drop("image_path").filter(F.col("path").isNotNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``line_no``, an increasing number that keeps the input order.

    Blank lines are skipped, other fields ignored, rows without a file dropped; a line
    that is not JSON stops the job. ``line_no`` orders the lines of one file by block and
    by row, whatever way Spark packs the blocks into tasks.
    """
    rows = spark.read.schema(MANIFEST).json(path, mode="FAILFAST")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return usable_rows(rows.withColumn("line_no", place))
