"""Writers. All of them write in parallel; none passes rows through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.operators.batch import batch_records
from burstlens.operators.scoring import EYE_FIELDS, SUMMARY_COLUMNS, result_json
from burstlens.sinks.files import write_crop_files, write_keyed_files, write_label_files

__all__ = [
    "write_batch",
    "write_bucketed_images",
    "write_coco_tables",
    "write_coverage",
    "write_crop_files",
    "write_crops",
    "write_dataset_manifest",
    "write_keyed_files",
    "write_label_files",
    "write_labels",
    "write_per_eye",
    "write_results",
    "write_summary",
]


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result documents, one JSON object per line."""
    results.select(result_json(F.col("result")).alias("value")).write.mode(mode).text(path)


def write_batch(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Batch records in manifest order: part files and their lines follow ``line_no``."""
    ordered = batch_records(rows).orderBy("line_no")
    ordered.select(F.col("record").alias("value")).write.mode(mode).text(path)


def write_crops(crops: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Gray crops with their tag (``crop_path``), as Parquet."""
    crops.write.mode(mode).parquet(path)


def write_labels(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Label lines below ``split=...`` folders, each line led by its label file and a tab."""
    value = F.concat_ws("\t", "label", "line")
    lines = labels.filter(F.col("line").isNotNull()).select(value.alias("value"), "split")
    lines.write.mode(mode).partitionBy("split").text(path)


def write_dataset_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``src, dst, label, split`` rows as JSON lines; ``src`` to ``dst`` is the copy list."""
    manifest.write.mode(mode).json(path)


def write_coco_tables(tables: dict[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """One JSON-lines folder per COCO table."""
    for name in ("images", "annotations", "categories"):
        tables[name].write.mode(mode).json(f"{root.rstrip('/')}/{name}")


def write_coverage(
    summary: DataFrame, histogram: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Coverage rates with their histogram as one JSON object.

    The histogram has one row per visibility value, seven at most.
    """
    entries = F.collect_list(F.struct("visibility", "n"))
    as_map = histogram.agg(F.map_from_entries(entries)).scalar()
    summary.withColumn("visibility_histogram", as_map).write.mode(mode).json(path)


def write_summary(scored: DataFrame, path: str, key: str = "image_id", mode: str = "errorifexists"):
    """Summary table, one row per image."""
    scored.select(key, *SUMMARY_COLUMNS).write.mode(mode).parquet(path)


def write_per_eye(scored: DataFrame, path: str, key: str = "image_id", mode: str = "errorifexists"):
    """Per-eye table, one row per eye."""
    eyes = scored.select(key, F.explode("scored").alias("eye"))
    eyes.select(key, *[f"eye.{n}" for n in EYE_FIELDS]).write.mode(mode).parquet(path)


def write_bucketed_images(
    images: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "image_id"
) -> None:
    """Images stored by hash of ``key``: later joins by that key leave the pixels in place."""
    writer = images.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(table)
