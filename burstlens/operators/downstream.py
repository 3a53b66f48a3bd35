"""Tables built on the summaries: gate, upsert, long scores, fusion, burst ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.operators.ordering import group_rank
from burstlens.session import scratch_path


def keyword_gate(
    images: DataFrame, keywords: DataFrame, wanted: Sequence[str] = C.SUBJECT_KEYWORDS,
    key: str = "image_id",
) -> DataFrame:
    """Images that carry one of the wanted keywords.

    The keyword rows shrink to one per image before they are shuffled.
    """
    tagged = keywords.filter(F.col("keyword").isin(*wanted)).select(key).distinct()
    return images.join(tagged, key, "left_semi")


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per image: the values of the latest run, the first ``created_at``.

    At equal ``updated_at`` the new run wins. ``max`` over a struct combines before the
    shuffle, so an image with very many rows costs one row per task.
    """
    both = old.withColumn("_run", F.lit(0)).unionByName(
        new.withColumn("_run", F.lit(1)), allowMissingColumns=True
    )
    values = [c for c in both.columns if c not in (key, "created_at", "updated_at", "_run")]
    latest = F.max(F.struct("updated_at", "_run", *values)).alias("_latest")
    merged = both.groupBy(key).agg(latest, F.min("created_at").alias("created_at"))
    return merged.select(
        key, *[F.col("_latest")[c].alias(c) for c in values], "created_at", F.col("_latest")["updated_at"].alias("updated_at")
    )


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_summary_table(
    summary: DataFrame, path: str, key: str = "image_id", buckets: int = 64
) -> None:
    """A summary table in folders ``bucket=...`` by hash of the key, one file each."""
    placed = summary.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    placed.write.partitionBy("bucket").mode("overwrite").parquet(path)


def upsert_table(new: DataFrame, path: str, key: str = "image_id", buckets: int = 64) -> None:
    """``upsert_latest`` of ``new`` into a table of ``write_summary_table``, in place.

    Only buckets that ``new`` has rows for are read and replaced; the others keep their files.
    The table's columns of ``new`` are written to the shared folder first, so that what makes it
    runs once, not again to tell its buckets.
    Buckets are replaced when the whole job is done (dynamic partition overwrite), so a job that
    fails leaves the table as it was. ``buckets`` is that of the table; columns are the table's.
    """
    spark = new.sparkSession
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c != "bucket"]
    staged = scratch_path(spark, "upsert")
    new.select(*columns).write.parquet(staged)
    fresh = spark.read.parquet(staged).withColumn("bucket", _bucket(key, buckets))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    old = table.filter(F.col("bucket").isin(touched)).select(*columns)
    merged = upsert_latest(old, fresh.select(*columns), key).select(*columns)
    placed = merged.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    writer = placed.write.partitionBy("bucket").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def model_scores(summary: DataFrame, key: str = "image_id") -> DataFrame:
    """Long score rows ``(image, model_name, score)``."""
    return summary.select(
        key, F.lit(C.SCORE_NAME).alias("model_name"), F.col("focus_score").alias("score")
    )


def fuse_scores(
    base: DataFrame, summary: DataFrame, min_confidence: float = C.CONFIDENCE_GATE,
    key: str = "image_id",
) -> DataFrame:
    """Adds ``final_score``: base and focus mixed where an eye is seen with confidence."""
    eye = summary.select(key, "eye_visible_count", "focus_score", "confidence")
    usable = (F.col("eye_visible_count") > 0) & (F.col("confidence") >= min_confidence)
    mixed = F.col("base") * C.BASE_WEIGHT + F.col("focus_score") * C.FOCUS_WEIGHT
    joined = base.join(eye, key, "left")
    return joined.select(
        *base.columns, F.when(usable, mixed).otherwise(F.col("base")).alias("final_score")
    )


def rank_in_stack(
    frames: DataFrame, stack: str = "stack_id", score: str = "focus_score", key: str = "image_id"
) -> DataFrame:
    """Adds ``stack_rank`` within a burst: best focus first, frames without one last.

    No frame is dropped, and a burst of any size is ranked over many tasks.
    """
    order = [F.col(score).desc_nulls_last(), F.col(key).asc()]
    return group_rank(frames, stack, order, "stack_rank")
