"""Inference of the six label keypoints from annotated body parts.

Each part is a nullable ``struct<x, y, v>`` column; null means "no annotation row", which
is not the same as an annotated but invisible part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens import constants as C


def mark(x: Column, y: Column, v: Column) -> Column:
    return F.struct(
        x.cast("double").alias("x"), y.cast("double").alias("y"), v.cast("int").alias("v")
    )


def shown(part: Column) -> Column:
    return F.coalesce(part["v"] > 0, F.lit(False))


def has_eye_or_head(parts: Mapping[str, Column]) -> Column:
    return (
        shown(parts["left_eye"])
        | shown(parts["right_eye"])
        | shown(parts["forehead"])
        | shown(parts["crown"])
    )


def head_top(parts: Mapping[str, Column]) -> Column:
    """The crown if it shows, else whatever the forehead says; null if neither exists."""
    return F.when(shown(parts["crown"]), parts["crown"]).otherwise(parts["forehead"])


def bilateral_eyes(parts: Mapping[str, Column], box: Column) -> Column:
    """``struct<left, right>``: seen eyes, mirrored eyes, or a guess from head or box."""
    left, right = parts["left_eye"], parts["right_eye"]
    none = F.lit(0)
    mirror = F.greatest(box["w"] * C.MIRROR_SHARE, F.lit(C.OFFSET_FLOOR_PX))
    spread = F.greatest(box["w"] * C.ANCHOR_SHARE, F.lit(C.OFFSET_FLOOR_PX))
    # The first landmark that has a row is the anchor, even if it is invisible.
    anchor = F.coalesce(parts["forehead"], head_top(parts), parts["beak"])
    mid_x, line_y = box["x"] + box["w"] / 2, box["y"] + box["h"] * C.EYE_LINE_SHARE

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("left"), b.alias("right"))

    def around(x: Column, y: Column, v: Column) -> Column:
        return pair(mark(x - spread, y, v), mark(x + spread, y, v))

    return (
        F.when(shown(left) & shown(right), pair(left, right))
        .when(shown(left), pair(left, mark(left["x"] + mirror, left["y"], none)))
        .when(shown(right), pair(mark(right["x"] - mirror, right["y"], none), right))
        .when(shown(anchor), around(anchor["x"], anchor["y"], anchor["v"]))
        .otherwise(around(mid_x, line_y, none))
    )


def shoulder(parts: Mapping[str, Column], side: str, box: Column) -> Column:
    """A shoulder between nape and wing, at the wing, or guessed from the box."""
    wing, nape = parts[f"{side}_wing"], parts["nape"]
    share = C.LEFT_SHOULDER_SHARE if side == "left" else C.RIGHT_SHOULDER_SHARE

    def blend(axis: str) -> Column:
        return nape[axis] * C.NAPE_WEIGHT + wing[axis] * C.WING_WEIGHT

    return (
        F.when(
            shown(wing) & shown(nape),
            mark(blend("x"), blend("y"), F.least(wing["v"], nape["v"])),
        )
        .when(shown(wing), wing)
        .otherwise(
            mark(
                box["x"] + box["w"] * share,
                box["y"] + box["h"] * C.SHOULDER_LINE_SHARE,
                F.lit(0),
            )
        )
    )


def keypoint_marks(parts: Mapping[str, Column], box: Column) -> dict[str, Column]:
    """The six label keypoints, keyed by name in label order."""
    zero = mark(F.lit(0.0), F.lit(0.0), F.lit(0))
    eyes = bilateral_eyes(parts, box)
    return {
        "beak": F.coalesce(parts["beak"], zero),
        "left_eye": eyes["left"],
        "right_eye": eyes["right"],
        "head_top": F.coalesce(head_top(parts), zero),
        "left_shoulder": shoulder(parts, "left", box),
        "right_shoulder": shoulder(parts, "right", box),
    }


def flatten_marks(marks: Mapping[str, Column]) -> Column:
    """18 numbers ``x, y, v`` in label order."""
    cells = []
    for name in C.KEYPOINT_NAMES:
        cells += [marks[name]["x"], marks[name]["y"], marks[name]["v"].cast("double")]
    return F.array(*cells)


def num_keypoints(keypoints: Column) -> Column:
    """Keypoints of a flat vector with a positive visibility value."""
    return F.size(F.filter(keypoints, lambda v, i: (i % 3 == 2) & (v > 0)))
