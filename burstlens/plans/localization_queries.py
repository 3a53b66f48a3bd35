"""Queries from detections to eyes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.operators import coverage as COV
from burstlens.operators import detections as D
from burstlens.operators import localize as L
from burstlens.plans import fixtures as X
from burstlens.plans.registry import query, view
from burstlens.schemas import DETECTIONS
from burstlens.session import scratch_path
from burstlens.sources import read_detections

_POINTS = ("beak", "left_eye", "right_eye", "head_top", "left_shoulder", "right_shoulder")


def _eye_sql(side: str, idx: int) -> str:
    x, y, c = (f"{side}_eye_{f}" for f in "xyc")
    outside = f"({x} < 0 OR {y} < 0 OR {x} > image_width OR {y} > image_height)"
    half = "greatest(head_width_px * 0.12, 8.0)"
    cascade = (
        f"CASE WHEN turned_away AND {c} < 0.45 THEN 'turned_away' WHEN {c} < 0.25 THEN 'hidden' "
        f"WHEN {outside} THEN 'occluded' WHEN {c} >= 0.45 THEN 'visible' "
        "ELSE 'partially_visible' END"
    )
    return f"""SELECT image_id, '{side}' AS eye_side, {idx} AS eye_idx, {x} AS center_x, {y} AS center_y,
  CASE WHEN ({cascade}) = 'occluded' THEN {c} * 0.7 ELSE {c} END AS confidence,
  {cascade} AS visibility, head_width_px, bbox_area_frac AS subject_area_frac,
  image_width, image_height,
  greatest(0.0, {x} - {half}) / image_width AS box_x,
  greatest(0.0, {y} - {half}) / image_height AS box_y,
  greatest(1.0, least(CAST(image_width AS DOUBLE), {x} + {half}) - greatest(0.0, {x} - {half}))
    / image_width AS box_w,
  greatest(1.0, least(CAST(image_height AS DOUBLE), {y} + {half}) - greatest(0.0, {y} - {half}))
    / image_height AS box_h
FROM v_{{p}}head"""


def localization_views(p: str, detections: str) -> None:
    """The chain of reference views ``v_<p>...`` over one detections view."""
    view(
        f"v_{p}area",
        f"""SELECT *, CASE WHEN image_width <= 0 OR image_height <= 0 THEN CAST(0 AS DOUBLE) ELSE
  greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1) / CAST(image_width * image_height AS DOUBLE) END
  AS bbox_area_frac FROM {detections}""",
    )
    view(
        f"v_{p}gated",
        f"SELECT * FROM v_{p}area WHERE bbox_confidence >= 0.25 AND bbox_area_frac >= 0.002",
    )
    view(
        f"v_{p}best",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id
  ORDER BY bbox_confidence DESC, det_idx, pk, sk, p) AS rn FROM v_{p}gated) WHERE rn = 1""",
    )
    view(
        f"v_{p}head",
        f"""SELECT *,
  CASE WHEN left_eye_c > 0 AND right_eye_c > 0 THEN greatest(abs(right_eye_x - left_eye_x), 16.0)
    WHEN left_shoulder_c > 0 AND right_shoulder_c > 0
    THEN greatest(abs(right_shoulder_x - left_shoulder_x) * 0.35, 16.0)
    ELSE greatest((x2 - x1) * 0.4, 16.0) END AS head_width_px,
  CASE WHEN beak_c < 0.25 THEN false
    WHEN left_eye_c < 0.25 AND right_eye_c < 0.25 THEN true
    WHEN head_top_c < 0.25 THEN false
    WHEN left_eye_c >= 0.25 AND right_eye_c >= 0.25
      THEN beak_y < (left_eye_y + right_eye_y) / 2 - 5
    WHEN left_eye_c >= 0.25 THEN beak_y < left_eye_y - 5
    ELSE beak_y < right_eye_y - 5 END AS turned_away
FROM v_{p}best""",
    )
    both = [_eye_sql(s, i).replace("{p}", p) for i, s in enumerate(("left", "right"))]
    view(f"v_{p}candidates", "\nUNION ALL\n".join(both))
    view(
        f"v_{p}eyes",
        f"SELECT * FROM v_{p}candidates WHERE NOT (visibility = 'hidden' AND confidence < 0.25)",
    )


localization_views("", "v_detections")
view(
    "v_notes",
    """SELECT i.image_id, CASE WHEN b.image_id IS NULL THEN 'no_pose_detection'
  WHEN e.n IS NULL THEN 'no_visible_eyes' ELSE '' END AS note
FROM v_images i LEFT JOIN v_best b ON i.image_id = b.image_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM v_eyes GROUP BY image_id) e
  ON i.image_id = e.image_id""",
)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gate_detections(X.detections(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.best_detection(_gated(spark, sf_dir), tie_break=X.DETECTION_ORDER)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.localize(_best(spark, sf_dir))


_BOX_COLUMNS = ("image_id", "det_idx", "pk", "sk", "p")


@query(
    """SELECT image_id, det_idx, x1, y1, x2, y2, bbox_confidence, beak_x, right_shoulder_c,
  image_width, image_height FROM v_detections"""
)
def detections_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written by a detector and scanned with the fixed schema."""
    path = scratch_path(spark, "detections")
    X.detections(spark, sf_dir).select(*[f.name for f in DETECTIONS.fields]).write.parquet(path)
    scan = read_detections(spark, path)
    return scan.select(
        "image_id", "det_idx", "x1", "y1", "x2", "y2", "bbox_confidence",
        F.get("keypoints", F.lit(0))["x"].alias("beak_x"),
        F.get("keypoints", F.lit(5))["confidence"].alias("right_shoulder_c"),
        "image_width", "image_height",
    )


@query(
    "\nUNION ALL\n".join(
        f"SELECT image_id, det_idx, pk, sk, p, CAST({k} AS INTEGER) AS kpt_idx, '{n}' AS name, "
        f"{n}_x AS x, {n}_y AS y, {n}_c AS confidence FROM v_detections"
        for k, n in enumerate(_POINTS)
    )
)
def keypoints_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keypoints_long(X.detections(spark, sf_dir), keys=_BOX_COLUMNS)


@query("SELECT image_id, det_idx, pk, sk, p, bbox_area_frac FROM v_area")
def bbox_area_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_area(X.detections(spark, sf_dir)).select(*_BOX_COLUMNS, "bbox_area_frac")


@query("SELECT image_id, det_idx, pk, sk, p, bbox_confidence, bbox_area_frac FROM v_gated")
def detection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select(*_BOX_COLUMNS, "bbox_confidence", "bbox_area_frac")


@query(
    "SELECT image_id, det_idx, pk, sk, p, bbox_confidence, x1, y1, x2, y2 FROM v_best"
)
def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select(*_BOX_COLUMNS, "bbox_confidence", "x1", "y1", "x2", "y2")


@query(
    """SELECT image_id, det_idx, pk, sk, p, bbox_confidence, CAST(row_number() OVER (PARTITION BY
  image_id ORDER BY bbox_confidence DESC, det_idx, pk, sk, p) AS INTEGER) AS subject_rank
FROM v_detections WHERE bbox_confidence >= 0.5"""
)
def multi_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.ranked_subjects(X.detections(spark, sf_dir), 0.5, tie_break=X.DETECTION_ORDER)
    return found.select(*_BOX_COLUMNS, "bbox_confidence", "subject_rank")


@query(
    "SELECT image_id, "
    + ", ".join(f"{n}_{f} AS k{i}_{f}" for i, n in enumerate(_POINTS) for f in "xyc")
    + " FROM v_best"
)
def debug_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = located(spark, sf_dir).select("image_id", "pose_keypoints")
    cells = [
        F.get(F.get("pose_keypoints", F.lit(i)), F.lit(j)).alias(f"k{i}_{f}")
        for i in range(len(_POINTS))
        for j, f in enumerate("xyc")
    ]
    return rows.select("image_id", *cells)


@query("SELECT image_id, head_width_px FROM v_head")
def head_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_head(_best(spark, sf_dir)).select("image_id", "head_width_px")


@query("SELECT image_id, turned_away FROM v_head")
def turned_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_head(_best(spark, sf_dir)).select("image_id", "turned_away")


@query("SELECT image_id, eye_side, eye_idx, center_x, center_y FROM v_candidates")
def eye_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    eyes = L.explode_eyes(L.eye_candidates(_best(spark, sf_dir)))
    return eyes.select("image_id", "eye_side", "eye_idx", "center_x", "center_y")


@query("SELECT image_id, eye_side, visibility, confidence FROM v_candidates")
def eye_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    eyes = L.explode_eyes(L.eye_candidates(_best(spark, sf_dir)))
    return eyes.select("image_id", "eye_side", "visibility", "confidence")


@query(
    """SELECT image_id, eye_side, eye_idx, visibility, confidence, head_width_px,
  subject_area_frac FROM v_eyes"""
)
def eyes_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    eyes = L.explode_eyes(located(spark, sf_dir))
    return eyes.select(
        "image_id", "eye_side", "eye_idx", "visibility", "confidence", "head_width_px",
        "subject_area_frac",
    )


@query("SELECT image_id, eye_side, box_x, box_y, box_w, box_h FROM v_eyes")
def eye_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    eyes = L.explode_eyes(located(spark, sf_dir))
    cells = [F.col("bbox_norm")[i].alias(f"box_{n}") for i, n in enumerate("xywh")]
    return eyes.select("image_id", "eye_side", *cells)


@query("SELECT image_id, note FROM v_notes")
def localize_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = L.localization_notes(X.image_list(spark, sf_dir), located(spark, sf_dir))
    return noted.select("image_id", F.array_join("notes", ",").alias("note"))


@query(
    """SELECT image_id, x1 / image_width AS sx, y1 / image_height AS sy,
  (x2 - x1) / image_width AS sw, (y2 - y1) / image_height AS sh FROM v_best"""
)
def subject_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = D.subject_boxes(_best(spark, sf_dir))
    cells = [F.col("subject_bbox_norm")[i].alias(f"s{n}") for i, n in enumerate("xywh")]
    return boxes.select("image_id", *cells)


@query(
    """SELECT image_id,
  CAST(trunc(greatest(0.0, x1 - (x2 - x1) * CAST(0.1 AS DOUBLE))) AS INTEGER) AS cx1,
  CAST(trunc(greatest(0.0, y1 - (y2 - y1) * CAST(0.1 AS DOUBLE))) AS INTEGER) AS cy1,
  CAST(trunc(least(CAST(image_width AS DOUBLE), x2 + (x2 - x1) * CAST(0.1 AS DOUBLE))) AS INTEGER)
    AS cx2,
  CAST(trunc(least(CAST(image_height AS DOUBLE), y2 + (y2 - y1) * CAST(0.1 AS DOUBLE))) AS INTEGER)
    AS cy2
FROM v_best"""
)
def subject_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = D.subject_crop_windows(_best(spark, sf_dir))
    corners = [F.col("subject_window")[c].alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")]
    return windows.select("image_id", *corners)


# --- coverage over the same images ----------------------------------------------------
def _coverage_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.beside(spark, sf_dir, "image_id", "total")
    return rows.select("image_id", (F.col("total") < 6000).alias("load_error"))


view(
    "v_flags",
    """SELECT i.image_id, b.total < 6000 AS load_error,
  b.total >= 6000 AND n.note <> 'no_pose_detection' AS detected,
  b.total >= 6000 AND n.note = 'no_pose_detection' AS no_pose,
  b.total >= 6000 AND n.note = 'no_visible_eyes' AS no_visible_eyes,
  CASE WHEN b.total >= 6000 THEN coalesce(e.n_visible, 0) ELSE 0 END AS n_visible
FROM v_images i JOIN v_beside b ON i.image_id = b.image_id
JOIN v_notes n ON i.image_id = n.image_id
LEFT JOIN (SELECT image_id, count(*) FILTER (WHERE visibility IN
    ('visible', 'partially_visible', 'occluded')) AS n_visible
  FROM v_eyes GROUP BY image_id) e ON i.image_id = e.image_id""",
)
view(
    "v_flag_eyes",
    """SELECT e.image_id, e.visibility, e.confidence FROM v_eyes e
JOIN v_flags f ON e.image_id = f.image_id WHERE NOT f.load_error""",
)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COV.coverage_flags(_coverage_images(spark, sf_dir), located(spark, sf_dir))


@query(
    """SELECT image_id, load_error, detected, no_pose, no_visible_eyes,
  CAST(n_visible AS INTEGER) AS n_visible FROM v_flags"""
)
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).drop("eyes")


@query(
    """SELECT count(*) AS total_images,
  round(100.0 * CAST(count(*) FILTER (WHERE detected) AS DOUBLE) / count(*), 2)
    AS detection_rate_pct,
  round(100.0 * CAST(count(*) FILTER (WHERE n_visible > 0) AS DOUBLE) / count(*), 2)
    AS visible_eye_rate_pct,
  round(100.0 * CAST(count(*) FILTER (WHERE no_pose) AS DOUBLE) / count(*), 2)
    AS no_pose_detection_pct,
  round(100.0 * CAST(count(*) FILTER (WHERE no_visible_eyes) AS DOUBLE) / count(*), 2)
    AS no_visible_eyes_pct,
  round(CAST(sum(n_visible) AS DOUBLE) / count(*), 3) AS mean_visible_eyes_per_image,
  (SELECT round(sum(confidence) / count(*), 4) FROM v_flag_eyes) AS mean_eye_confidence
FROM v_flags"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COV.coverage_summary(_flags(spark, sf_dir))


@query(
    """SELECT visibility, count(*) AS n FROM v_flag_eyes GROUP BY visibility
UNION ALL SELECT 'load_error', count(*) FROM v_flags WHERE load_error HAVING count(*) > 0"""
)
def visibility_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COV.visibility_histogram(_flags(spark, sf_dir))


@query("SELECT path, image_id FROM (SELECT file_name AS path, image_id FROM v_note_images) "
       "ORDER BY path LIMIT 100")  # fmt: skip
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = X.annotation_images(spark, sf_dir)
    listed = images.select(F.col("file_name").alias("path"), "image_id")
    return COV.limit_images(listed, 100)


@query("SELECT eye_side, count(*) AS n, min(head_width_px) AS narrowest FROM v_eyes "
       "GROUP BY eye_side")  # fmt: skip
def eyes_per_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained eyes per side: the long form feeding an aggregate."""
    eyes = L.explode_eyes(located(spark, sf_dir))
    return eyes.groupBy("eye_side").agg(
        F.count("*").alias("n"), F.min("head_width_px").alias("narrowest")
    )


__all__ = ["located", "localization_views"]
