"""Eye crops: windows, pixels, moments.

Pixels are the heavy side. A window is turned back into stored coordinates, cut out of
the image on the JVM side, and only the cut bytes go to Python, where gray conversion,
turning and measuring share one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions import geometry as G
from burstlens.functions import pixels as P


def with_shown_dims(best: DataFrame, photos: DataFrame, key: str = "image_id") -> DataFrame:
    """``best`` with ``image_width`` and ``image_height`` of the photo as displayed.

    Detectors report the stored dims; eyes, boxes and windows are judged in the turned photo.
    Only dims and orientation of ``photos`` are read here. They grow with the photos, so they are
    not broadcast, however small their file is.
    """
    shown = G.oriented_dims(F.col("width"), F.col("height"), F.col("orientation"))
    dims = photos.select(key, shown.alias("_shown")).select(
        key, F.col("_shown.width").alias("image_width"), F.col("_shown.height").alias("image_height")
    )
    return best.drop("image_width", "image_height").join(dims.hint("shuffle_hash"), key)


def eye_windows(located: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds ``windows`` (one struct per eye) in displayed coordinates; local to a row."""
    windows = F.transform(
        "eyes",
        lambda e: F.struct(
            e["eye_side"].alias("eye_side"),
            e["eye_idx"].alias("eye_idx"),
            G.crop_window(e["center_x"], e["center_y"], e["head_width_px"], width, height).alias(
                "window"
            ),
        ),
    )
    return located.withColumn("windows", windows)


def join_located(
    images: DataFrame, located: DataFrame, key: str = "image_id", how: str = "inner",
    broadcast: bool = False,
) -> DataFrame:
    """Images with the columns of ``located``; pixels are not sorted, and do not move if bucketed.

    One plan at every size: a hash join that builds on the located rows. Images stored
    bucketed by the key (see ``sinks.write_bucketed_images``) stay in place. With
    ``broadcast`` the caller vouches that the located rows (below 1 kB each) are few.
    """
    return images.join(located.hint("broadcast" if broadcast else "shuffle_hash"), key, how)


def cut_windows(joined: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per eye with the stored ``scanlines`` of its window.

    Needs ``data, width, height, n_channels, orientation, windows``; an empty window has
    null scanlines.
    """
    w, h, turn = F.col("width"), F.col("height"), F.col("orientation")

    def cut(item: Column) -> Column:
        return F.struct(
            item["eye_side"].alias("eye_side"),
            item["eye_idx"].alias("eye_idx"),
            item["window"].alias("window"),
            window_lines(item["window"], w, h, turn).alias("scanlines"),
        )

    cuts = joined.select(
        key, "n_channels", "orientation", F.explode(F.transform("windows", cut)).alias("cut")
    )
    return cuts.select(key, "n_channels", "orientation", "cut.*")


def window_lines(window: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Stored scanlines behind a displayed window of ``data``, null for an empty one."""
    stored = G.stored_window(window, width, height, orientation)
    lines = P.scanlines(F.col("data"), width, F.col("n_channels"), stored)
    return F.when(~G.window_is_empty(window), lines)


def measure_eyes(joined: DataFrame, bgr: bool = True) -> DataFrame:
    """Adds ``m0`` and ``m1``, the moments of both eyes, and drops the pixels.

    One row per image throughout: both eyes share a Python hop, and no join is needed to
    bring the moments back to the image.
    """
    w, h, turn = F.col("width"), F.col("height"), F.col("orientation")

    def lines_of(eye_idx: int) -> Column:
        mine = F.filter("windows", lambda item: item["eye_idx"] == eye_idx)
        return window_lines(F.get(mine, F.lit(0))["window"], w, h, turn)

    lines = {f"_lines{i}": lines_of(i) for i in (0, 1)}
    cut = joined.withColumns(lines).drop("data", "windows")
    measured = {
        f"m{i}": P.scanline_moments(F.col(f"_lines{i}"), F.col("n_channels"), turn, bgr)
        for i in (0, 1)
    }
    return cut.withColumns(measured).drop("_lines0", "_lines1")


def extract_crops(cuts: DataFrame, bgr: bool = True, key: str = "image_id") -> DataFrame:
    """Gray crops (``gray`` binary, row-major) with their pixel dims."""
    crop = P.scanline_gray(
        F.col("scanlines"), F.col("n_channels"), F.col("orientation"), bgr
    )
    return cuts.withColumn("_crop", crop).select(key, "eye_side", "eye_idx", "window", "_crop.*")


def crop_moments(cuts: DataFrame, bgr: bool = True, key: str = "image_id") -> DataFrame:
    """Moments per eye straight from the cut scanlines; no gray crop is kept."""
    moments = P.scanline_moments(
        F.col("scanlines"), F.col("n_channels"), F.col("orientation"), bgr
    )
    return cuts.withColumn("_m", moments).select(key, "eye_side", "eye_idx", "_m.*")


def gray_crop_moments(crops: DataFrame, *keys: str) -> DataFrame:
    """Moments of stored gray crops (``gray``, ``width``)."""
    m = P.gray_moments(F.col("gray"), F.col("width"))
    return crops.withColumn("_m", m).select(*keys, "_m.*")
