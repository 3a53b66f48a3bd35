"""Localisation coverage of a split of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.functions.numbers import exact_round
from burstlens.operators.localize import localization_notes


def limit_images(images: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first ``n`` images by path; 0 means all of them."""
    return images.orderBy(path).limit(n) if n > 0 else images


def coverage_flags(images: DataFrame, located: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image: ``load_error, detected, no_pose, no_visible_eyes, n_visible, eyes``.

    ``images`` carries ``load_error``; such images count in no other flag.
    """
    noted = localization_notes(images, located.select(key, "eyes"), key)
    loaded = ~F.col("load_error")
    no_pose = F.array_contains("notes", C.NOTE_NO_DETECTION)
    counted = F.filter("eyes", lambda e: e["visibility"].isin(*C.COUNTED_VISIBILITIES))
    return noted.select(
        key,
        "load_error",
        (loaded & ~no_pose).alias("detected"),
        (loaded & no_pose).alias("no_pose"),
        (loaded & F.array_contains("notes", C.NOTE_NO_EYES)).alias("no_visible_eyes"),
        F.when(loaded & F.col("eyes").isNotNull(), F.size(counted)).otherwise(0).alias("n_visible"),
        F.when(loaded, F.col("eyes")).alias("eyes"),
    )


def coverage_summary(flags: DataFrame) -> DataFrame:
    """One row of rates over all images, load errors included in the denominator."""
    confidences = F.transform("eyes", lambda e: e["confidence"])
    per_image = flags.withColumn("_n", F.coalesce(F.size("eyes"), F.lit(0))).withColumn(
        "_sum", F.aggregate(F.coalesce(confidences, F.array().cast("array<double>")), F.lit(0.0), lambda a, c: a + c)
    )
    totals = per_image.agg(
        F.count("*").alias("total_images"),
        F.count_if("detected").alias("_detected"),
        F.count_if(F.col("n_visible") > 0).alias("_seen"),
        F.count_if("no_pose").alias("_no_pose"),
        F.count_if("no_visible_eyes").alias("_no_eyes"),
        F.coalesce(F.sum("n_visible"), F.lit(0)).alias("_visible"),
        F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("_eyes"),
        F.coalesce(F.sum("_sum"), F.lit(0.0)).alias("_conf"),
    )

    def ratio(top: str, bottom: str, digits: int, scale: float = 1.0):
        share = F.lit(scale) * F.col(top) / F.col(bottom)
        return F.when(F.col(bottom) > 0, exact_round(share, digits)).otherwise(F.lit(0.0))

    return totals.select(
        "total_images",
        ratio("_detected", "total_images", 2, 100.0).alias("detection_rate_pct"),
        ratio("_seen", "total_images", 2, 100.0).alias("visible_eye_rate_pct"),
        ratio("_no_pose", "total_images", 2, 100.0).alias("no_pose_detection_pct"),
        ratio("_no_eyes", "total_images", 2, 100.0).alias("no_visible_eyes_pct"),
        ratio("_visible", "total_images", 3).alias("mean_visible_eyes_per_image"),
        ratio("_conf", "_eyes", 4).alias("mean_eye_confidence"),
    )


def visibility_histogram(flags: DataFrame) -> DataFrame:
    """Eyes per visibility, and ``load_error`` images, in one aggregate."""
    labels = F.when(F.col("load_error"), F.array(F.lit("load_error"))).otherwise(
        F.transform("eyes", lambda e: e["visibility"])
    )
    return (
        flags.select(F.explode(labels).alias("visibility"))
        .groupBy("visibility")
        .agg(F.count("*").alias("n"))
    )
