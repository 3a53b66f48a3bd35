"""From the best detection of an image to its eyes.

The wide form keeps one row per image with an ``eyes`` array of at most two structs, so
everything up to the summary is local to a row; ``explode_eyes`` gives the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.constants import DEFAULT_GATES, Gates
from burstlens.functions import geometry as G


def with_head(best: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Adds ``head_width_px`` and ``turned_away``."""
    kps = F.col("keypoints")
    return best.withColumns(
        {
            "head_width_px": G.head_width(kps, F.col("x1"), F.col("x2")),
            "turned_away": G.turned_away(kps, gates),
        }
    )


def _eye(side: str, idx: int, gates: Gates, retained_only: bool) -> Column:
    point = G.keypoint(F.col("keypoints"), f"{side}_eye")
    width, height, head = F.col("image_width"), F.col("image_height"), F.col("head_width_px")
    verdict = G.eye_visibility(point, head, F.col("turned_away"), width, height, gates)
    eye = F.struct(
        F.lit(side).alias("eye_side"),
        F.lit(idx).alias("eye_idx"),
        point["x"].alias("center_x"),
        point["y"].alias("center_y"),
        verdict["confidence"].alias("confidence"),
        verdict["visibility"].alias("visibility"),
        G.eye_bbox_norm(point["x"], point["y"], head, width, height).alias("bbox_norm"),
        head.alias("head_width_px"),
        F.col("bbox_area_frac").alias("subject_area_frac"),
    )
    wanted = point.isNotNull()
    if retained_only:
        wanted = wanted & G.retained(verdict["visibility"], verdict["confidence"], gates)
    return F.when(wanted, eye)


def _with_eyes(best: DataFrame, gates: Gates, retained_only: bool) -> DataFrame:
    sides = [_eye(side, i, gates, retained_only) for i, side in enumerate(C.EYE_SIDES)]
    return with_head(best, gates).withColumn("eyes", F.array_compact(F.array(*sides)))


def eye_candidates(best: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Adds ``eyes``: every eye that has a keypoint, left then right."""
    return _with_eyes(best, gates, retained_only=False)


def localize(best: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """One row per image with a detection: retained eyes, debug keypoints.

    Eyes that are hidden or too small and not trusted are dropped.
    """
    located = _with_eyes(best, gates, retained_only=True)
    return located.withColumn("pose_keypoints", G.debug_keypoints(F.col("keypoints")))


def explode_eyes(located: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per eye."""
    return located.select(key, F.explode("eyes").alias("eye")).select(key, "eye.*")


def notes(found: Column, eyes: Column) -> Column:
    """Notes of an image: no detection, no retained eye, or none at all."""
    return (
        F.when(found.isNull(), F.array(F.lit(C.NOTE_NO_DETECTION)))
        .when(F.size(eyes) == 0, F.array(F.lit(C.NOTE_NO_EYES)))
        .otherwise(F.array().cast("array<string>"))
    )


def localization_notes(images: DataFrame, located: DataFrame, key: str = "image_id") -> DataFrame:
    """All images with their eyes and ``notes``; images without a detection are noted."""
    joined = images.join(located.withColumn("_found", F.lit(True)), key, "left")
    return joined.withColumn("notes", notes(F.col("_found"), F.col("eyes"))).drop("_found")
