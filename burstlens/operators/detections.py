"""Operators over detection rows: naming, gates, best subject, subject boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burstlens.constants import DEFAULT_GATES, KEYPOINT_NAMES, SUBJECT_PAD_SHARE, Gates
from burstlens.functions import geometry as G


def with_area(df: DataFrame) -> DataFrame:
    """Adds ``bbox_area_frac``, the share of the image that the box covers."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]
    return df.withColumn("bbox_area_frac", G.bbox_area_frac(*box))


def keypoints_long(df: DataFrame, keys: Sequence[str] = ("image_id", "det_idx")) -> DataFrame:
    """One row per named keypoint; at most the first six entries are known."""
    names = F.array(*[F.lit(n) for n in KEYPOINT_NAMES])
    known = F.slice("keypoints", 1, len(KEYPOINT_NAMES))
    return df.select(*keys, F.posexplode(known).alias("kpt_idx", "point")).select(
        *keys, "kpt_idx", F.get(names, F.col("kpt_idx")).alias("name"), "point.*"
    )


def gate_detections(df: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Boxes that are confident and large enough; adds ``bbox_area_frac``."""
    trusted = df.filter(F.col("bbox_confidence") >= gates.box_confidence)
    return with_area(trusted).filter(F.col("bbox_area_frac") >= gates.box_area_share)


def best_detection(
    df: DataFrame, key: str = "image_id", tie_break: Sequence[str] = ("det_idx",)
) -> DataFrame:
    """Per image the box of highest confidence, the earliest one on ties.

    The filter on ``row_number`` becomes a group limit that runs before the shuffle too:
    each task sends at most one row per image, however many boxes an image has.
    """
    order = [F.col("bbox_confidence").desc(), *[F.col(c).asc() for c in tie_break]]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def all_detections(df: DataFrame, min_confidence: float) -> DataFrame:
    """Every subject above a confidence, for frames with several animals."""
    return df.filter(F.col("bbox_confidence") >= min_confidence)


def ranked_subjects(
    df: DataFrame,
    min_confidence: float,
    most: int | None = None,
    key: str = "image_id",
    tie_break: Sequence[str] = ("det_idx",),
) -> DataFrame:
    """``all_detections`` with ``subject_rank`` in their image, most confident first.

    With ``most`` only so many per image are kept; that filter is a group limit, which runs
    before the shuffle too.
    """
    order = [F.col("bbox_confidence").desc(), *[F.col(c).asc() for c in tie_break]]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = all_detections(df, min_confidence).withColumn("subject_rank", rank)
    return ranked if most is None else ranked.filter(F.col("subject_rank") <= most)


def best_of_array(detections: Column, width: Column, height: Column, gates: Gates = DEFAULT_GATES):
    """Best gated entry of a nested ``array<struct>`` of detections; needs no shuffle."""

    def passes(d: Column) -> Column:
        area = G.bbox_area_frac(d["x1"], d["y1"], d["x2"], d["y2"], width, height)
        return (d["bbox_confidence"] >= gates.box_confidence) & (area >= gates.box_area_share)

    ranked = F.transform(
        F.filter(detections, passes),
        lambda d: F.struct(
            d["bbox_confidence"].alias("c"), (-d["det_idx"]).alias("i"), d.alias("d")
        ),
    )
    return F.array_max(ranked)["d"]


def flatten_best(
    df: DataFrame, gates: Gates = DEFAULT_GATES, keep_all: bool = False
) -> DataFrame:
    """Nested layout (one row per image) to the row of its best detection.

    Images without one are left out, or have nulls with ``keep_all``.
    """
    best = best_of_array(F.col("detections"), F.col("image_width"), F.col("image_height"), gates)
    picked = df.withColumn("best", best)
    if not keep_all:
        picked = picked.filter(F.col("best").isNotNull())
    others = [c for c in df.columns if c != "detections"]
    return with_area(picked.select(*others, "best.*"))


def subject_columns() -> list[Column]:
    """The best detection's normalised box and its confidence, as the result document has them."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]
    return [
        G.subject_bbox_norm(*box).alias("subject_bbox_norm"),
        F.col("bbox_confidence").alias("subject_confidence"),
    ]


def subject_boxes(best: DataFrame) -> DataFrame:
    """Adds ``subject_bbox_norm`` of the best detection."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]
    return best.withColumn("subject_bbox_norm", G.subject_bbox_norm(*box))


def subject_crop_windows(best: DataFrame, pad: float = SUBJECT_PAD_SHARE) -> DataFrame:
    """Adds ``subject_window``, the padded pixel window of the subject."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]
    return best.withColumn("subject_window", G.subject_window(*box, pad=pad))
