"""Geometry of subjects, heads and eyes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.constants import DEFAULT_GATES, Gates


def keypoint(keypoints: Column, name: str) -> Column:
    """The named entry of a keypoint array, null where the array is too short."""
    return F.get(keypoints, F.lit(C.KEYPOINT_INDEX[name]))


def at_least(point: Column, confidence: float) -> Column:
    return F.coalesce(point["confidence"] >= confidence, F.lit(False))


def bbox_area_frac(x1, y1, x2, y2, width, height) -> Column:
    """Share of the image covered by a box; 0 for images without an area."""
    dx = F.greatest(F.lit(0.0), x2 - x1)
    dy = F.greatest(F.lit(0.0), y2 - y1)
    pixels = (width.cast("bigint") * height.cast("bigint")).cast("double")
    return F.when((width <= 0) | (height <= 0), F.lit(0.0)).otherwise(dx * dy / pixels)


def head_width(keypoints: Column, x1: Column, x2: Column) -> Column:
    """Head width from the eyes, else from the shoulders, else from the box."""

    def both(a: Column, b: Column) -> Column:
        return (a["confidence"] > 0) & (b["confidence"] > 0)

    left, right = keypoint(keypoints, "left_eye"), keypoint(keypoints, "right_eye")
    lsh, rsh = keypoint(keypoints, "left_shoulder"), keypoint(keypoints, "right_shoulder")
    floor = F.lit(C.HEAD_WIDTH_FLOOR_PX)
    return (
        F.when(both(left, right), F.greatest(F.abs(right["x"] - left["x"]), floor))
        .when(both(lsh, rsh), F.greatest(F.abs(rsh["x"] - lsh["x"]) * C.SHOULDER_TO_HEAD, floor))
        .otherwise(F.greatest((x2 - x1) * C.BOX_TO_HEAD, floor))
    )


def turned_away(keypoints: Column, gates: Gates = DEFAULT_GATES) -> Column:
    """The beak shows but no eye does, or the beak rises above the eye line."""
    seen = {
        name: at_least(keypoint(keypoints, name), gates.keypoint_confidence)
        for name in ("beak", "left_eye", "right_eye", "head_top")
    }
    left_y = keypoint(keypoints, "left_eye")["y"]
    right_y = keypoint(keypoints, "right_eye")["y"]
    eye_line = (
        F.when(seen["left_eye"] & seen["right_eye"], (left_y + right_y) / 2)
        .when(seen["left_eye"], left_y)
        .when(seen["right_eye"], right_y)
    )
    raised = seen["head_top"] & (keypoint(keypoints, "beak")["y"] < eye_line - C.BEAK_RISE_PX)
    # With no eye in sight the eye line is null, which the coalesce reads as "turned away".
    return seen["beak"] & F.when(eye_line.isNull(), F.lit(True)).otherwise(
        F.coalesce(raised, F.lit(False))
    )


def eye_visibility(
    point: Column, head: Column, away: Column, width: Column, height: Column,
    gates: Gates = DEFAULT_GATES,
) -> Column:
    """``struct<visibility, confidence>`` of one eye keypoint; the first match decides."""
    conf = point["confidence"]
    crop_px = 2 * F.greatest(head * C.EYE_SHARE_OF_HEAD, F.lit(gates.eye_crop_px / 2))
    outside = (point["x"] < 0) | (point["y"] < 0) | (point["x"] > width) | (point["y"] > height)

    def verdict(label: str, confidence: Column) -> Column:
        return F.struct(F.lit(label).alias("visibility"), confidence.alias("confidence"))

    return (
        F.when(away & (conf < gates.clear_confidence), verdict("turned_away", conf))
        .when(conf < gates.keypoint_confidence, verdict("hidden", conf))
        .when(crop_px < gates.eye_crop_px, verdict("too_small", conf * C.TOO_SMALL_FACTOR))
        .when(outside, verdict("occluded", conf * C.OUT_OF_FRAME_FACTOR))
        .when(conf >= gates.clear_confidence, verdict("visible", conf))
        .otherwise(verdict("partially_visible", conf))
    )


def retained(visibility: Column, confidence: Column, gates: Gates = DEFAULT_GATES) -> Column:
    """Hidden and too-small eyes are dropped unless their keypoint is trusted."""
    return ~(visibility.isin("hidden", "too_small") & (confidence < gates.keypoint_confidence))


def eye_bbox_norm(x: Column, y: Column, head: Column, width: Column, height: Column) -> Column:
    """``[x, y, w, h]`` of the eye box, clipped to the image and divided by its size."""
    half = F.greatest(head * C.EYE_SHARE_OF_HEAD, F.lit(C.EYE_BOX_FLOOR_PX))
    w, h = width.cast("double"), height.cast("double")
    x1, y1 = F.greatest(F.lit(0.0), x - half), F.greatest(F.lit(0.0), y - half)
    x2, y2 = F.least(w, x + half), F.least(h, y + half)
    one = F.lit(1.0)
    return F.array(x1 / w, y1 / h, F.greatest(one, x2 - x1) / w, F.greatest(one, y2 - y1) / h)


def debug_keypoints(keypoints: Column) -> Column:
    """Six ``[x, y, confidence]`` rows in keypoint order, zeros where one is missing."""
    zero = F.lit(0.0)
    rows = []
    for name in C.KEYPOINT_NAMES:
        point = keypoint(keypoints, name)
        rows.append(F.array(*[F.coalesce(point[f], zero) for f in ("x", "y", "confidence")]))
    return F.array(*rows)


def subject_bbox_norm(x1, y1, x2, y2, width, height) -> Column:
    w, h = width.cast("double"), height.cast("double")
    return F.when((width > 0) & (height > 0), F.array(x1 / w, y1 / h, (x2 - x1) / w, (y2 - y1) / h))


def subject_window(x1, y1, x2, y2, width, height, pad: float = C.SUBJECT_PAD_SHARE) -> Column:
    """Padded subject window, clipped to the image and cut to whole pixels."""
    dx, dy = (x2 - x1) * F.lit(pad), (y2 - y1) * F.lit(pad)
    zero = F.lit(0.0)
    return F.struct(
        F.greatest(zero, x1 - dx).cast("int").alias("x1"),
        F.greatest(zero, y1 - dy).cast("int").alias("y1"),
        F.least(width.cast("double"), x2 + dx).cast("int").alias("x2"),
        F.least(height.cast("double"), y2 + dy).cast("int").alias("y2"),
    )


def crop_window(x: Column, y: Column, head: Column, width: Column, height: Column) -> Column:
    """Half-open pixel window around an eye; half-even rounding, clipped to the image."""
    radius = F.rint(
        F.greatest(head * C.EYE_SHARE_OF_HEAD, F.lit(C.CROP_RADIUS_FLOOR_PX))
    ).cast("int")
    cx, cy = F.rint(x).cast("int"), F.rint(y).cast("int")
    return F.struct(
        F.greatest(F.lit(0), cx - radius).alias("x1"),
        F.greatest(F.lit(0), cy - radius).alias("y1"),
        F.least(width.cast("int"), cx + radius).alias("x2"),
        F.least(height.cast("int"), cy + radius).alias("y2"),
    )


def window_is_empty(window: Column) -> Column:
    return (window["x2"] <= window["x1"]) | (window["y2"] <= window["y1"])


def swaps_axes(orientation: Column) -> Column:
    return F.coalesce(orientation.between(5, 8), F.lit(False))


def oriented_dims(width: Column, height: Column, orientation: Column) -> Column:
    """``struct<width, height>`` of the image as displayed."""
    swap = swaps_axes(orientation)
    return F.struct(
        F.when(swap, height).otherwise(width).alias("width"),
        F.when(swap, width).otherwise(height).alias("height"),
    )


def orient_point(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Where the stored pixel ``(x, y)`` is displayed; stored dims, orientation 1-8."""
    rx, ry = width - 1 - x, height - 1 - y

    def point(u: Column, v: Column) -> Column:
        return F.struct(u.alias("x"), v.alias("y"))

    return (
        F.when(orientation == 2, point(rx, y))
        .when(orientation == 3, point(rx, ry))
        .when(orientation == 4, point(x, ry))
        .when(orientation == 5, point(y, x))
        .when(orientation == 6, point(ry, x))
        .when(orientation == 7, point(ry, rx))
        .when(orientation == 8, point(y, rx))
        .otherwise(point(x, y))
    )


def stored_window(window: Column, width: Column, height: Column, orientation: Column) -> Column:
    """The stored-pixel window behind a window of the displayed image.

    Only the crop is ever turned, never the whole image; ``width`` and ``height``
    are the stored dims.
    """
    w, h = width.cast("int"), height.cast("int")
    swap = swaps_axes(orientation)
    # Displayed x runs along the stored y axis when the axes are swapped.
    ax1 = F.when(swap, window["y1"]).otherwise(window["x1"])
    ax2 = F.when(swap, window["y2"]).otherwise(window["x2"])
    ay1 = F.when(swap, window["x1"]).otherwise(window["y1"])
    ay2 = F.when(swap, window["x2"]).otherwise(window["y2"])
    flip_x = F.coalesce(orientation.isin(2, 3, 7, 8), F.lit(False))
    flip_y = F.coalesce(orientation.isin(3, 4, 6, 7), F.lit(False))
    return F.struct(
        F.when(flip_x, w - ax2).otherwise(ax1).alias("x1"),
        F.when(flip_y, h - ay2).otherwise(ay1).alias("y1"),
        F.when(flip_x, w - ax1).otherwise(ax2).alias("x2"),
        F.when(flip_y, h - ay1).otherwise(ay2).alias("y2"),
    )
