"""Queries over photos: orientation, windows, crops, and the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.functions import geometry as G
from burstlens.functions import names as N
from burstlens.operators import crops as CR
from burstlens.operators import detections as D
from burstlens.operators import localize as L
from burstlens.operators import predict as PR
from burstlens.operators import scoring as SC
from burstlens.plans import fixtures as X
from burstlens.plans.localization_queries import localization_views
from burstlens.plans.registry import query, view
from burstlens.sources import images as SR
from burstlens.plans.scoring_queries import (
    metric_views,
    moment_views,
    rounded_summary,
    summary_views,
)

localization_views("photo_", "v_photo_detections")

_RADIUS = "CAST(round_even(greatest(e.head_width_px * 0.12, 12.0), 0) AS INTEGER)"
_CX = "CAST(round_even(e.center_x, 0) AS INTEGER)"
_CY = "CAST(round_even(e.center_y, 0) AS INTEGER)"
def _gray_at(u: str, v: str) -> str:
    sx, sy = X.stored_xy(u, v)
    return X.GRAY_SQL.replace("sx", f"({sx})").replace("sy", f"({sy})")


def crop_views(p: str) -> None:
    """Reference views from ``v_<p>eyes`` on photos to ``v_<p>summary``."""
    view(
        f"v_{p}windows",
        f"""SELECT d.*, e.eye_side, e.eye_idx, e.visibility, e.confidence,
  greatest(0, {_CX} - {_RADIUS}) AS u1, greatest(0, {_CY} - {_RADIUS}) AS v1,
  least(d.dw, {_CX} + {_RADIUS}) AS u2, least(d.dh, {_CY} + {_RADIUS}) AS v2
FROM v_{p}eyes e JOIN v_displayed d ON e.image_id = d.image_id""",
    )
    view(
        f"v_{p}shapes",
        f"""SELECT *, CASE WHEN u2 <= u1 OR v2 <= v1 THEN 0 ELSE u2 - u1 END AS w,
  CASE WHEN u2 <= u1 OR v2 <= v1 THEN 0 ELSE v2 - v1 END AS h FROM v_{p}windows""",
    )
    view(
        f"v_{p}crops",
        f"""SELECT image_id, eye_side, eye_idx, visibility, confidence, w AS shown_px,
  image_id * 2 + eye_idx AS key, CAST(h AS BIGINT) AS h, CAST(w AS BIGINT) AS w,
  [{_gray_at("(u1 + i % w)", "(v1 + i // w)")} for i in range(w * h)] AS g
FROM v_{p}shapes""",
    )
    moment_views(
        f"v_{p}moments",
        f"v_{p}crops",
        "image_id, eye_side, eye_idx, visibility, confidence, shown_px",
    )
    metric_views(p, f"v_{p}moments")
    summary_views(p, "v_photo_ids", f"v_{p}focus")


view("v_photo_ids", "SELECT image_id FROM v_photos")
crop_views("photo_")
view("v_given_eyes", X.GIVEN_EYES_SQL)
crop_views("given_")


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = D.gate_detections(X.photo_detections(spark, sf_dir))
    best = D.best_detection(gated, tie_break=X.DETECTION_ORDER)
    best = CR.with_shown_dims(best, X.photo_meta(spark, sf_dir))
    return CR.eye_windows(L.localize(best), F.col("image_width"), F.col("image_height"))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows meet the photos' dims and orientation; pixels are made behind that join, so none move."""
    windows = _located(spark, sf_dir).select("image_id", "windows")
    joined = CR.join_located(X.photo_meta(spark, sf_dir), windows)
    return CR.cut_windows(X.with_pixels(joined))


_SX, _SY = X.stored_xy("(image_id % dw)", "(image_id % dh)")


@query(
    f"""SELECT image_id, dw AS display_width, dh AS display_height,
  CAST({_SX} AS BIGINT) AS stored_x, CAST({_SY} AS BIGINT) AS stored_y,
  image_id % dw AS display_x, image_id % dh AS display_y FROM v_displayed"""
)
def orient_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed dims, a one-pixel window back to stored pixels, and forth again."""
    meta = X.photo_meta(spark, sf_dir)
    w, h, o = F.col("width"), F.col("height"), F.col("orientation")
    shown = meta.withColumn("dims", G.oriented_dims(w, h, o))
    u = (F.col("image_id") % F.col("dims.width")).cast("int")
    v = (F.col("image_id") % F.col("dims.height")).cast("int")
    window = F.struct(u.alias("x1"), v.alias("y1"), (u + 1).alias("x2"), (v + 1).alias("y2"))
    stored = shown.withColumn("s", G.stored_window(window, w, h, o))
    back = stored.withColumn("d", G.orient_point(F.col("s.x1"), F.col("s.y1"), w, h, o))
    return back.select(
        "image_id",
        F.col("dims.width").alias("display_width"),
        F.col("dims.height").alias("display_height"),
        F.col("s.x1").cast("bigint").alias("stored_x"),
        F.col("s.y1").cast("bigint").alias("stored_y"),
        F.col("d.x").cast("bigint").alias("display_x"),
        F.col("d.y").cast("bigint").alias("display_y"),
    )


@query("SELECT image_id, eye_side, u1, v1, u2, v2 FROM v_photo_windows")
def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _located(spark, sf_dir).select("image_id", F.explode("windows").alias("i"))
    corners = {"u1": "x1", "v1": "y1", "u2": "x2", "v2": "y2"}
    cells = [F.col(f"i.window.{c}").alias(n) for n, c in corners.items()]
    return items.select("image_id", "i.eye_side", *cells)


_C1X, _C1Y = X.stored_xy("u1", "v1")
_C2X, _C2Y = X.stored_xy("(u2 - 1)", "(v2 - 1)")
view(
    "v_photo_stored",
    f"""SELECT *, least({_C1X}, {_C2X}) AS sx1, greatest({_C1X}, {_C2X}) + 1 AS sx2,
  least({_C1Y}, {_C2Y}) AS sy1, greatest({_C1Y}, {_C2Y}) + 1 AS sy2
FROM v_photo_shapes WHERE w > 0""",
)


def _bgr_hex(x: str, y: str) -> str:
    return (
        f"printf('%02X%02X%02X', (({x}) * ({y}) + image_id * 5) % 256, "
        f"(({x}) * 5 + ({y}) * 11 + image_id) % 256, "
        f"(({x}) * 7 + ({y}) * 3 + image_id * 11 + (({x}) * ({y})) % 13) % 256)"
    )


_STORED_HEX = _bgr_hex("sx1 + i % (sx2 - sx1)", "sy1 + i // (sx2 - sx1)")


@query(
    f"""SELECT image_id, eye_side, CAST(sy2 - sy1 AS INTEGER) AS n_lines,
  md5(array_to_string([{_STORED_HEX} for i in range((sx2 - sx1) * (sy2 - sy1))], '')) AS body
FROM v_photo_stored"""
)
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bytes behind every eye window that is not empty."""
    cuts = _cuts(spark, sf_dir).filter(F.col("scanlines").isNotNull())
    text = F.array_join(F.transform("scanlines", F.hex), "")
    return cuts.select(
        "image_id", "eye_side", F.size("scanlines").alias("n_lines"), F.md5(text).alias("body")
    )


@query(
    """SELECT image_id, eye_side, CAST(w AS INTEGER) AS crop_width_px,
  CAST(h AS INTEGER) AS crop_height_px, CASE WHEN w = 0 THEN md5('00')
  ELSE md5(array_to_string([printf('%02X', v) for v in g], '')) END AS body FROM v_photo_crops"""
)
def crop_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray crops as displayed."""
    crops = CR.extract_crops(_cuts(spark, sf_dir))
    return crops.select(
        "image_id", "eye_side", "crop_width_px", "crop_height_px",
        F.md5(F.hex("gray")).alias("body"),
    )


@query(
    """SELECT image_id, eye_side,
  concat('debug/part_', image_id, '_', eye_side, '_eye.jpg') AS by_stem,
  concat('debug/', substr(md5(file), 1, 8), '_', eye_side, '_eye.jpg') AS by_md5
FROM v_photo_windows"""
)
def crop_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.photo_meta(spark, sf_dir).select("image_id", "file")
    eyes = L.explode_eyes(_located(spark, sf_dir)).join(files, "image_id")
    path, side = F.col("file"), F.col("eye_side")
    return eyes.select(
        "image_id",
        "eye_side",
        N.crop_path("debug", path, side).alias("by_stem"),
        N.crop_path("debug", path, side, tag="md5").alias("by_md5"),
    )


@query(
    """SELECT image_id, eye_side, n_px, sum_v, sum_v2, sum_lap, sum_lap2,
  round(sum_grad, 4) AS sum_grad, sum_resid, n_bright, n_dark FROM v_photo_moments"""
)
def photo_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of real windows, of any shape, straight from the photos."""
    return CR.crop_moments(_cuts(spark, sf_dir)).select(
        "image_id", "eye_side", "n_px", "sum_v", "sum_v2", "sum_lap", "sum_lap2",
        F.round("sum_grad", 4).alias("sum_grad"), "sum_resid", "n_bright", "n_dark",
    )


@query(
    """SELECT image_id, best_eye_side, eye_visible_count, round(focus_score, 6) AS focus_score,
  round(sharpness_score, 6) AS sharpness_score, round(clarity_score, 6) AS clarity_score,
  quality_grade, failure_type, round(confidence, 6) AS confidence, model_name, model_version
FROM v_photo_summary"""
)
def photo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and detections to summaries: localise, crop, measure, aggregate."""
    scored = SC.score_photos(
        X.photo_meta(spark, sf_dir),
        X.photo_detections(spark, sf_dir),
        tie_break=X.DETECTION_ORDER,
        pixels=X.with_pixels,
    )
    return rounded_summary(scored, "image_id")


_FILE_SUMMARY = """round({0}focus_score, 6) AS focus_score,
  round({0}sharpness_score, 6) AS sharpness_score, round({0}clarity_score, 6) AS clarity_score,
  {0}quality_grade, {0}failure_type, round({0}confidence, 6) AS confidence"""


@query(
    f"""SELECT f.image_id, f.file, s.best_eye_side, s.eye_visible_count,
  {_FILE_SUMMARY.format("s.")}, CASE WHEN f.broken THEN 'decode_error' END AS error
FROM v_photos f LEFT JOIN v_photo_summary s ON f.image_id = s.image_id AND NOT f.broken"""
)
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files, detections and orientations by path to summaries; broken files are marked."""
    return X.in_lots(spark, sf_dir, "file-summaries", lambda root, lot: _scored_lot(spark, sf_dir, root, lot))


def _scored_lot(spark: SparkSession, sf_dir: str, root: str, lot: Column) -> DataFrame:
    """The image files below ``root``, which are the photos of ``lot``."""
    base = SR.plain_path(F.lit(root))
    meta = X.photo_meta(spark, sf_dir).filter(lot)
    turns = meta.select("image_id", F.concat(base, F.lit("/"), "file").alias("path"), "orientation")
    # Paths grow with the photos, so they are not broadcast; the best box of each photo meets its path.
    boxes = X.photo_detections(spark, sf_dir).filter(lot)
    best = D.best_detection(D.gate_detections(boxes), tie_break=X.DETECTION_ORDER)
    paths = turns.select("image_id", "path").hint("shuffle_hash")
    boxes = best.join(paths, "image_id").drop("image_id")
    scored = PR.score_folder(spark, root, boxes, turns, tie_break=X.DETECTION_ORDER)
    named = scored.withColumn("file", F.replace("path", F.concat(base, F.lit("/")), F.lit("")))
    image_id = F.regexp_extract("file", r"part_(\d+)\.", 1).cast("bigint")
    rows = rounded_summary(named.withColumn("image_id", image_id), "image_id", "file", "error")
    return rows.drop("model_name", "model_version")


@query(f"SELECT image_id, best_eye_side, eye_visible_count, {_FILE_SUMMARY.format('')} FROM v_given_summary")
def score_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eyes located elsewhere, of every visibility, on the photos."""
    photos, eyes = X.photo_meta(spark, sf_dir), X.given_eyes(spark, sf_dir)
    scored = SC.score_located(photos, eyes, pixels=X.with_pixels)
    return rounded_summary(scored, "image_id").drop("model_name", "model_version")


def _brightness_model():
    """A stand-in model: one box per image, its confidence the mean brightness."""
    import numpy as np

    def predict(batch):
        answers = []
        for data, w, h, n in zip(
            batch["data"], batch["width"], batch["height"], batch["n_channels"], strict=True
        ):
            total = int(np.frombuffer(data, dtype=np.uint8).sum(dtype=np.int64))
            level = total / float(w * h * n * 255)
            points = [
                {"x": w * (k + 1) / 8.0, "y": h * (k + 2) / 9.0, "confidence": level}
                for k in range(6)
            ]
            box = {"x1": 0.0, "y1": 0.0, "x2": float(w), "y2": float(h)}
            answers.append([{**box, "bbox_confidence": level, "keypoints": points}])
        return answers

    return predict


view("v_px", "SELECT image_id, width, height, unnest(range(width * height)) AS i FROM v_photos")
view("v_xy", "SELECT image_id, width, height, i % width AS x, i // width AS y FROM v_px")
view(
    "v_lit",
    """SELECT image_id, width, height,
  CAST(sum((x * y + image_id * 5) % 256 + (x * 5 + y * 11 + image_id) % 256
    + (x * 7 + y * 3 + image_id * 11 + (x * y) % 13) % 256) AS BIGINT) AS total
FROM v_xy GROUP BY image_id, width, height""",
)


@query(
    """SELECT image_id, CAST(total AS DOUBLE) / CAST(width * height * 3 * 255 AS DOUBLE) AS level,
  CAST(width AS DOUBLE) AS x2, CAST(height AS DOUBLE) AS y2,
  greatest(abs(width * 3 / CAST(8 AS DOUBLE) - width * 2 / CAST(8 AS DOUBLE)), 16.0)
    AS head_width_px,
  CASE WHEN CAST(total AS DOUBLE) / CAST(width * height * 3 * 255 AS DOUBLE) >= 0.45
    THEN 'visible' ELSE 'partially_visible' END AS visibility
FROM v_lit"""
)
def predict_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model over the photos; its nested detections need no shuffle."""
    photos = X.photos(spark, sf_dir)
    found = PR.with_detections(photos, _brightness_model).select(
        "image_id",
        "detections",
        F.col("width").cast("bigint").alias("image_width"),
        F.col("height").cast("bigint").alias("image_height"),
    )
    eyes = L.localize(D.flatten_best(found))
    left = F.get("eyes", F.lit(0))
    return eyes.select(
        "image_id",
        F.col("bbox_confidence").alias("level"),
        "x2",
        "y2",
        "head_width_px",
        left["visibility"].alias("visibility"),
    )
