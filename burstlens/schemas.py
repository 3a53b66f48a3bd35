"""Explicit schemas of every source and of the result document."""

from __future__ import annotations

from pyspark.sql import types as T

from burstlens.constants import SUMMARY_FIELD

MANIFEST = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("image_path", T.StringType())]
)

# Where a line of a text source stands; see ``sources.annotations.placed_lines``.
PLACE = "decimal(38,0)"
PLACE_BITS = 55  # of a place that is a long; 8 more tell part ids of one name apart

KEYPOINT = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

DETECTION = T.StructType(
    [
        T.StructField("det_idx", T.LongType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("x2", T.DoubleType()),
        T.StructField("y2", T.DoubleType()),
        T.StructField("bbox_confidence", T.DoubleType()),
        T.StructField("keypoints", T.ArrayType(KEYPOINT)),
    ]
)

DETECTIONS = T.StructType(
    [T.StructField("image_id", T.LongType())]
    + DETECTION.fields
    + [
        T.StructField("image_width", T.LongType()),
        T.StructField("image_height", T.LongType()),
    ]
)

COCO_IMAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
    ]
)

COCO_ANNOTATION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("image_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("keypoints", T.ArrayType(T.DoubleType())),
        T.StructField("num_keypoints", T.LongType()),
    ]
)

COCO_CATEGORY = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]
)

COCO_DOCUMENT = T.StructType(
    [
        T.StructField("images", T.ArrayType(COCO_IMAGE)),
        T.StructField("annotations", T.ArrayType(COCO_ANNOTATION)),
        T.StructField("categories", T.ArrayType(COCO_CATEGORY)),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("best_eye_side", T.StringType()),
        T.StructField("eye_visible_count", T.IntegerType()),
        T.StructField("focus_score", T.DoubleType()),
        T.StructField("sharpness_score", T.DoubleType()),
        T.StructField("clarity_score", T.DoubleType()),
        T.StructField("quality_grade", T.IntegerType()),
        T.StructField("failure_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
    ]
)

EYE_DETECTION = T.StructType(
    [
        T.StructField("eye_side", T.StringType()),
        T.StructField("bbox_norm", T.ArrayType(T.DoubleType())),
        T.StructField("visibility", T.StringType()),
        T.StructField("detection_confidence", T.DoubleType()),
        T.StructField("crop_path", T.StringType()),
    ]
)

DEBUG = T.StructType(
    [
        T.StructField("crop_paths", T.ArrayType(T.StringType())),
        T.StructField("pose_keypoints", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("notes", T.ArrayType(T.StringType())),
    ]
)

RESULT = T.StructType(
    [
        T.StructField(SUMMARY_FIELD, SUMMARY),
        T.StructField("detections", T.ArrayType(EYE_DETECTION)),
        T.StructField("debug", DEBUG),
        T.StructField("subject_bbox_norm", T.ArrayType(T.DoubleType())),
        T.StructField("subject_confidence", T.DoubleType()),
    ]
)

# Sums over the pixels of one crop; every score is a column over these.
MOMENTS = T.StructType(
    [
        T.StructField("crop_width_px", T.IntegerType()),
        T.StructField("crop_height_px", T.IntegerType()),
        T.StructField("n_px", T.LongType()),
        T.StructField("sum_v", T.LongType()),
        T.StructField("sum_v2", T.LongType()),
        T.StructField("sum_lap", T.LongType()),
        T.StructField("sum_lap2", T.LongType()),
        T.StructField("sum_grad", T.DoubleType()),
        T.StructField("sum_resid", T.LongType()),
        T.StructField("n_bright", T.LongType()),
        T.StructField("n_dark", T.LongType()),
    ]
)
