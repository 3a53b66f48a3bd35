"""Incremental runs of the row-local stages over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from burstlens.constants import DEFAULT_GATES, Gates
from burstlens.operators.detections import flatten_best
from burstlens.operators.localize import explode_eyes, localize
from burstlens.schemas import DETECTION

NESTED_DETECTIONS = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("image_width", T.LongType()),
        T.StructField("image_height", T.LongType()),
        T.StructField("detections", T.ArrayType(DETECTION)),
    ]
)


def read_detection_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New Parquet files of nested detections (one row per image) as a stream."""
    reader = spark.readStream.schema(NESTED_DETECTIONS).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def eyes_of_stream(detections: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Eye rows of nested detections: no state, no shuffle, the same code as in batch."""
    return explode_eyes(localize(flatten_best(detections, gates), gates))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived since the last run, once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
