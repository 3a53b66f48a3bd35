"""Queries from crops to scores, summaries and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.functions import scores as S
from burstlens.operators import batch as B
from burstlens.operators import crops as CR
from burstlens.operators import downstream as DS
from burstlens.operators import scoring as SC
from burstlens.plans import fixtures as X
from burstlens.plans.localization_queries import located
from burstlens.plans.registry import query, view
from burstlens.session import scratch_path


# The blur of sigma 1.2: nine weights of 256, rounded, the middle one taking up the rest.
TAPS = (0, 4, 21, 60, 86, 60, 21, 4, 0)


# --- reference SQL of the pixel measures --------------------------------------------
def _fold(i: str, n: str) -> str:
    period = f"greatest(2 * ({n} - 1), 1)"
    m = f"((({i}) % {period} + {period}) % {period})"
    return f"least({m}, {period} - {m})"


def _at(dx: int, dy: int, source: str = "g") -> str:
    x = f"i % w + {dx}"
    y = f"i // w + {dy}"
    return f"{source}[{_fold(y, 'h')} * w + {_fold(x, 'w')} + 1]"


def moment_views(name: str, source: str, keep: str) -> None:
    """Reference view ``name`` of moments over ``source`` (``key, h, w, g``, row-major)."""
    lap = f"{_at(0, -1)} + {_at(0, 1)} + {_at(-1, 0)} + {_at(1, 0)} - 4 * g[i + 1]"
    gx = f"({_at(1, -1)} - {_at(-1, -1)} + 2 * ({_at(1, 0)} - {_at(-1, 0)}) + {_at(1, 1)} - {_at(-1, 1)})"
    gy = f"({_at(-1, 1)} - {_at(-1, -1)} + 2 * ({_at(0, 1)} - {_at(0, -1)}) + {_at(1, 1)} - {_at(1, -1)})"
    taps = [(k - 4, t) for k, t in enumerate(TAPS)]
    across = " + ".join(f"{t} * g[i // w * w + {_fold(f'i % w + {k}', 'w')} + 1]" for k, t in taps)
    down = " + ".join(f"{t} * b[{_fold(f'i // w + {k}', 'h')} * w + i % w + 1]" for k, t in taps)
    view(
        f"{name}_lists",
        f"""SELECT {keep}, key, h, w, g, [{lap} for i in range(h * w)] AS lap,
  [sqrt(CAST({gx} * {gx} + {gy} * {gy} AS DOUBLE)) for i in range(h * w)] AS grad,
  [{across} for i in range(h * w)] AS b
FROM {source}""",
    )
    view(
        f"{name}_blurred",
        f"""SELECT * EXCLUDE (b), [abs(g[i + 1] - (({down} + 32768) >> 16)) for i in range(h * w)]
  AS resid FROM {name}_lists""",
    )
    view(
        name,
        f"""SELECT {keep}, key, h, w, CAST(len(g) AS BIGINT) AS n_px,
  CAST(coalesce(list_sum(g), 0) AS BIGINT) AS sum_v,
  CAST(coalesce(list_sum([v * v for v in g]), 0) AS BIGINT) AS sum_v2,
  CASE WHEN h < 2 OR w < 2 THEN 0 ELSE CAST(list_sum(lap) AS BIGINT) END AS sum_lap,
  CASE WHEN h < 2 OR w < 2 THEN 0 ELSE CAST(list_sum([v * v for v in lap]) AS BIGINT) END
    AS sum_lap2,
  CASE WHEN h < 2 OR w < 2 THEN CAST(0 AS DOUBLE) ELSE list_sum(grad) END AS sum_grad,
  CASE WHEN h < 2 OR w < 2 THEN 0 ELSE CAST(list_sum(resid) AS BIGINT) END AS sum_resid,
  CAST(len([v for v in g if v >= 250]) AS BIGINT) AS n_bright,
  CAST(len([v for v in g if v <= 5]) AS BIGINT) AS n_dark
FROM {name}_blurred""",
    )


def metric_views(p: str, moments: str) -> None:
    """Reference view ``v_<p>focus``: metrics and focus over ``moments`` with ``shown_px``."""
    variance = (
        "greatest(0.0, (CAST(n_px AS DOUBLE) * {sq} - CAST({s} AS DOUBLE) * {s}) "
        "/ (CAST(n_px AS DOUBLE) * n_px))"
    )
    lap = variance.format(s="sum_lap", sq="sum_lap2")
    val = variance.format(s="sum_v", sq="sum_v2")
    bad = "(n_px < 1 OR h < 2 OR w < 2)"
    mean = "CAST(sum_v AS DOUBLE) / n_px"
    view(
        f"v_{p}metrics",
        f"""SELECT *,
  CASE WHEN {bad} THEN 0.0 ELSE greatest(0.0, least(1.0, {lap} / 500.0)) END AS sharpness_score,
  CASE WHEN {bad} THEN 0.0 ELSE greatest(0.0, least(1.0, sqrt({val}) / 64.0)) END AS clarity_score,
  CASE WHEN {bad} THEN 0.0 ELSE greatest(0.0, least(1.0, sum_grad / n_px / 80.0)) END
    AS edge_energy,
  CASE WHEN {bad} THEN 1.0 ELSE
    greatest(0.0, least(1.0, CAST(sum_resid AS DOUBLE) / n_px / 25.0)) END AS noise_penalty,
  CASE WHEN {bad} OR shown_px <= 0 THEN CAST(0 AS DOUBLE)
    WHEN shown_px < 24 THEN CAST(shown_px AS DOUBLE) / 24.0 * 0.5
    ELSE greatest(0.5, least(1.0, CAST(shown_px AS DOUBLE) / 48.0)) END AS size_factor,
  CASE WHEN {bad} THEN 'hidden_eye'
    WHEN {mean} > 220 OR CAST(n_bright AS DOUBLE) / n_px > 0.15 THEN 'overexposed'
    WHEN {mean} < 35 OR CAST(n_dark AS DOUBLE) / n_px > 0.25 THEN 'low_contrast'
    ELSE 'none' END AS crop_failure
FROM {moments}""",
    )
    view(
        f"v_{p}focus",
        f"""SELECT *, greatest(0.0, least(1.0,
  (0.45 * sharpness_score + 0.35 * clarity_score + 0.20 * edge_energy) * size_factor
  * greatest(0.0, 1.0 - noise_penalty))) AS focus_score FROM v_{p}metrics""",
    )


def summary_views(p: str, images: str, eyes: str) -> None:
    """Reference view ``v_<p>summary`` over scored eyes (one row per eye)."""
    view(
        f"v_{p}seen",
        f"SELECT * FROM {eyes} WHERE visibility NOT IN ('hidden', 'too_small', 'turned_away')",
    )
    view(
        f"v_{p}top",
        f"""SELECT *, CASE WHEN shown_px < 24 THEN confidence * 0.5 ELSE confidence END AS conf
FROM (SELECT *, row_number() OVER (PARTITION BY image_id
    ORDER BY focus_score DESC, sharpness_score DESC, eye_idx) AS rn,
  count(*) OVER (PARTITION BY image_id) AS n_seen FROM v_{p}seen) WHERE rn = 1""",
    )
    view(
        f"v_{p}summary",
        f"""SELECT i.image_id, t.eye_side AS best_eye_side,
  CAST(coalesce(t.n_seen, 0) AS INTEGER) AS eye_visible_count,
  coalesce(t.focus_score, 0.0) AS focus_score,
  coalesce(t.sharpness_score, 0.0) AS sharpness_score,
  coalesce(t.clarity_score, 0.0) AS clarity_score,
  CAST(CASE WHEN t.image_id IS NULL THEN 0 ELSE least(
    CASE WHEN t.conf < 0.45 THEN 2 ELSE 4 END,
    CASE WHEN t.focus_score >= 0.85 THEN 4 WHEN t.focus_score >= 0.65 THEN 3
      WHEN t.focus_score >= 0.45 THEN 2 WHEN t.focus_score >= 0.20 THEN 1 ELSE 0 END) END
    AS INTEGER) AS quality_grade,
  CASE WHEN t.image_id IS NULL OR t.conf < 0.45 THEN 'none'
    WHEN t.size_factor < 0.4 THEN 'subject_too_small'
    WHEN t.crop_failure <> 'none' THEN t.crop_failure
    WHEN t.sharpness_score < 0.15 AND t.focus_score < 0.25 THEN 'defocus'
    WHEN t.focus_score < 0.20 THEN 'motion_blur'
    WHEN t.noise_penalty > 0.6 THEN 'noise' ELSE 'none' END AS failure_type,
  coalesce(t.conf, 0.0) AS confidence,
  'eye_quality_heuristic' AS model_name, '0.1.0' AS model_version
FROM {images} i LEFT JOIN v_{p}top t ON i.image_id = t.image_id""",
    )


moment_views("v_moments", "v_crops", "shown_px, detection_confidence")
metric_views("", "v_moments")
view(
    "v_eye_scores",
    """SELECT e.image_id, e.eye_side, e.eye_idx, e.visibility, e.confidence, f.shown_px,
  f.sharpness_score, f.clarity_score, f.edge_energy, f.focus_score, f.noise_penalty,
  f.size_factor, f.crop_failure
FROM v_eyes e JOIN v_focus f
  ON (e.image_id * 2 + e.eye_idx) % (SELECT count(*) FROM embeddings) = f.key""",
)
summary_views("", "v_images", "v_eye_scores")


# --- crops ----------------------------------------------------------------------------
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments per gray grid; the reported crop width comes with the crop."""
    crops = X.gray_grids(spark, sf_dir)
    keys = ("vec_id", "shown_px", "detection_confidence")
    return CR.gray_crop_moments(crops, *keys)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = _moments(spark, sf_dir).withColumn("crop_width_px", F.col("shown_px"))
    return SC.score_crops(moments)


def eye_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of both eyes of every image: eye ``(image, i)`` shows one of the grids."""
    moments = _moments(spark, sf_dir).withColumn("crop_width_px", F.col("shown_px"))
    n = X.table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("eye_idx")
    eyes = X.image_list(spark, sf_dir).select("image_id", sides)
    keyed = eyes.withColumn("vec_id", (F.col("image_id") * 2 + F.col("eye_idx")) % n)
    return keyed.join(moments, "vec_id").drop("vec_id", "shown_px", "detection_confidence")


def scored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.score_images(
        X.image_list(spark, sf_dir),
        X.detections(spark, sf_dir),
        eye_moments(spark, sf_dir),
        tie_break=X.DETECTION_ORDER,
    )


@query(
    """SELECT key AS vec_id, n_px, sum_v, sum_v2, sum_lap, sum_lap2,
  round(sum_grad, 4) AS sum_grad, sum_resid, n_bright, n_dark FROM v_moments"""
)
def crop_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moments(spark, sf_dir)
    return m.select(
        "vec_id", "n_px", "sum_v", "sum_v2", "sum_lap", "sum_lap2",
        F.round("sum_grad", 4).alias("sum_grad"), "sum_resid", "n_bright", "n_dark",
    )


def _metric(name: str, sql_name: str | None = None):
    source = sql_name or name
    value = f"round({source}, 6)" if sql_name is None else source

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        column = "failure_type" if sql_name else name
        cell = F.col(column) if sql_name else F.round(column, 6)
        return _scored(spark, sf_dir).select("vec_id", cell.alias(name))

    return f"SELECT key AS vec_id, {value} AS {name} FROM v_metrics", run


for _key, _name, _sql in (
    ("sharpness", "sharpness_score", None),
    ("edge_energy", "edge_energy", None),
    ("clarity", "clarity_score", None),
    ("noise_penalty", "noise_penalty", None),
    ("size_factor", "size_factor", None),
    ("exposure", "exposure", "crop_failure"),
):
    _oracle, _run = _metric(_name, _sql)
    query(_oracle, name=_key)(_run)


@query(
    """SELECT key AS vec_id, CAST(h AS INTEGER) AS crop_height_px, sharpness_score, noise_penalty,
  size_factor, crop_failure AS failure_type FROM v_metrics WHERE h < 2 OR w < 2"""
)
def degenerate_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of a single line: no signal, whatever their pixels are."""
    scored = _scored(spark, sf_dir).filter("crop_height_px < 2 OR crop_width_px < 2")
    return scored.select(
        "vec_id", "crop_height_px", "sharpness_score", "noise_penalty", "size_factor",
        "failure_type",
    )


@query("SELECT key AS vec_id, round(focus_score, 6) AS focus_score FROM v_focus")
def focus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round("focus_score", 6).alias("focus_score"))


# Each grid as the only, visible eye of an image.
view(
    "v_lone_eyes",
    """SELECT key AS image_id, 'left' AS eye_side, 0 AS eye_idx, 'visible' AS visibility,
  detection_confidence AS confidence, * EXCLUDE (key, detection_confidence) FROM v_focus""",
)
view("v_lone_images", "SELECT vec_id AS image_id FROM embeddings")
summary_views("lone_", "v_lone_images", "v_lone_eyes")


def _lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    eye = F.struct(
        *[
            {
                "eye_side": F.lit("left"),
                "eye_idx": F.lit(0),
                "visibility": F.lit("visible"),
                "bbox_norm": F.array(*[F.lit(0.0)] * 4),
                "crop_path": F.lit(None),
            }
            .get(n, F.col(n))
            .cast(t)
            .alias(n)
            for n, t in SC.EYE_FIELDS.items()
        ]
    )
    scored = _scored(spark, sf_dir)
    return SC.summarize(scored.select(F.col("vec_id").alias("image_id"), F.array(eye).alias("scored")))


@query("SELECT image_id, confidence FROM v_lone_summary")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lone(spark, sf_dir).select("image_id", "confidence")


@query("SELECT image_id, failure_type FROM v_lone_summary")
def failure_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lone(spark, sf_dir).select("image_id", "failure_type")


@query(
    """SELECT key AS vec_id, CASE WHEN sharpness_score < 0.15 AND focus_score < 0.25 THEN 'defocus'
  WHEN focus_score < 0.20 THEN 'motion_blur' ELSE 'none' END AS blur FROM v_focus"""
)
def blur_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    blur = S.blur_failure(F.col("focus_score"), F.col("sharpness_score"))
    return _scored(spark, sf_dir).select("vec_id", blur.alias("blur"))


@query("SELECT image_id, quality_grade FROM v_lone_summary")
def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lone(spark, sf_dir).select("image_id", "quality_grade")


# --- image level ------------------------------------------------------------------------
@query(
    """SELECT i.image_id, CAST(count(s.image_id) AS INTEGER) AS eye_visible_count
FROM v_images i LEFT JOIN v_seen s ON i.image_id = s.image_id GROUP BY i.image_id"""
)
def visible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_images(spark, sf_dir).select("image_id", "eye_visible_count")


@query(
    """SELECT image_id, eye_side AS best_eye_side, round(focus_score, 6) AS focus_score
FROM v_top"""
)
def best_eye(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scored_images(spark, sf_dir).withColumn("best", SC.best_eye(F.col("scored")))
    found = best.filter(F.col("best").isNotNull())
    return found.select(
        "image_id",
        F.col("best.eye_side").alias("best_eye_side"),
        F.round("best.focus_score", 6).alias("focus_score"),
    )


_SUMMARY_SQL = """SELECT image_id, best_eye_side, eye_visible_count,
  round(focus_score, 6) AS focus_score, round(sharpness_score, 6) AS sharpness_score,
  round(clarity_score, 6) AS clarity_score, quality_grade, failure_type,
  round(confidence, 6) AS confidence, model_name, model_version FROM """


def rounded_summary(scored: DataFrame, *keys: str) -> DataFrame:
    cells = []
    for name in SC.SUMMARY_COLUMNS:
        is_score = name in ("focus_score", "sharpness_score", "clarity_score", "confidence")
        cells.append(F.round(name, 6).alias(name) if is_score else F.col(name))
    return scored.select(*keys, *cells)


@query(_SUMMARY_SQL + "v_summary")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: detections and crops to one summary per image."""
    return rounded_summary(scored_images(spark, sf_dir), "image_id")


@query(_SUMMARY_SQL + "v_summary WHERE eye_visible_count = 0")
def empty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_images(spark, sf_dir).filter("eye_visible_count = 0")
    return rounded_summary(scored, "image_id")


@query(
    """SELECT b.image_id, CAST(NULL AS VARCHAR) AS best_eye_side, CAST(0 AS INTEGER) AS eye_visible_count,
  CAST(0 AS DOUBLE) AS focus_score, 'none' AS failure_type, 'skipped' AS note,
  CAST(0 AS INTEGER) AS quality_grade
FROM v_beside b WHERE b.image_id NOT IN (SELECT image_id FROM v_beside
  WHERE keyword IN ('wildlife', 'birds', 'animals'))"""
)
def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that the keyword gate leaves out get the default result."""
    images = X.image_list(spark, sf_dir)
    keywords = X.beside(spark, sf_dir, "image_id", "keyword")
    skipped = images.join(DS.keyword_gate(images, keywords), "image_id", "left_anti")
    empty = SC.empty_result(skipped)
    return empty.select(
        "image_id", "best_eye_side", "eye_visible_count", "focus_score", "failure_type",
        F.array_join("notes", ",").alias("note"), "quality_grade",
    )


def _with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("img/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    return SC.score_images(
        X.image_list(spark, sf_dir),
        X.detections(spark, sf_dir),
        eye_moments(spark, sf_dir),
        tie_break=X.DETECTION_ORDER,
        crop_base="debug",
        path=path,
    )


@query(
    """SELECT i.image_id, coalesce(string_agg(concat_ws('|', e.eye_side, e.visibility,
    concat('debug/', i.image_id, '_', e.eye_side, '_eye.jpg')), ';' ORDER BY e.eye_idx)
    FILTER (WHERE e.eye_side IS NOT NULL), '')
  AS eyes FROM v_images i LEFT JOIN v_eyes e ON i.image_id = e.image_id GROUP BY i.image_id"""
)
def detections_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eyes of an image in order, with their crop paths, as one text."""
    found = SC.to_result(_with_paths(spark, sf_dir), "image_id")
    texts = F.transform(
        "result.detections",
        lambda e: F.concat_ws("|", e["eye_side"], e["visibility"], e["crop_path"]),
    )
    return found.select("image_id", F.array_join(texts, ";").alias("eyes"))


@query(
    """SELECT s.image_id, s.best_eye_side, s.quality_grade, s.failure_type, n.note,
  CAST((SELECT count(*) FROM v_eyes e WHERE e.image_id = s.image_id) AS INTEGER) AS n_eyes,
  CASE WHEN n.note = 'no_pose_detection' THEN 0 ELSE 6 END AS n_rows,
  b.bbox_confidence AS subject_confidence, b.x1 / b.image_width AS subject_x,
  (b.y2 - b.y1) / b.image_height AS subject_h
FROM v_summary s JOIN v_notes n ON s.image_id = n.image_id
LEFT JOIN v_best b ON s.image_id = b.image_id"""
)
def result_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document through its JSON text and back."""
    text = SC.to_result(scored_images(spark, sf_dir), "image_id").select(
        "image_id", SC.result_json(F.col("result")).alias("text")
    )
    back = text.select("image_id", SC.parse_result(F.col("text")).alias("r"))
    summary = F.col("r")[SC.C.SUMMARY_FIELD]
    return back.select(
        "image_id",
        summary["best_eye_side"].alias("best_eye_side"),
        summary["quality_grade"].alias("quality_grade"),
        summary["failure_type"].alias("failure_type"),
        F.array_join("r.debug.notes", ",").alias("note"),
        F.size("r.detections").alias("n_eyes"),
        F.size("r.debug.pose_keypoints").alias("n_rows"),
        F.col("r.subject_confidence").alias("subject_confidence"),
        F.get("r.subject_bbox_norm", F.lit(0)).alias("subject_x"),
        F.get("r.subject_bbox_norm", F.lit(3)).alias("subject_h"),
    )


view(
    "v_manifest",
    """SELECT image_id AS line, coalesce(nullif(path, ''), nullif(image_path, '')) AS path
FROM v_beside WHERE coalesce(nullif(path, ''), nullif(image_path, '')) IS NOT NULL""",
)


@query(
    """SELECT m.line, m.path, CASE WHEN b.image_id IS NULL THEN 'file_not_found' END AS error,
  s.best_eye_side, s.quality_grade, s.failure_type
FROM v_manifest m
LEFT JOIN (SELECT image_id, concat('img/', image_id, '.jpg') AS file FROM v_beside
  WHERE total >= 16000) b ON m.path = b.file
LEFT JOIN v_summary s ON s.image_id = b.image_id"""
)
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines to results; files that do not exist give error rows."""
    from burstlens.sources.manifest import usable_rows

    manifest = usable_rows(
        X.beside(spark, sf_dir, F.col("image_id").alias("line"), "path", "image_path")
    )
    file = F.concat(F.lit("img/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    listing = X.beside(spark, sf_dir, "image_id", "total").filter("total >= 16000")
    listing = listing.select(file.alias("path"))
    scored = scored_images(spark, sf_dir).withColumns({"path": file, "decoded": F.lit(True)})
    rows = B.score_batch(manifest, listing, scored)
    summary = F.col("result")[SC.C.SUMMARY_FIELD]
    return rows.select(
        "line", "path", "error",
        summary["best_eye_side"].alias("best_eye_side"),
        summary["quality_grade"].alias("quality_grade"),
        summary["failure_type"].alias("failure_type"),
    )


@query(
    """SELECT image_id, concat_ws(',',
  CASE WHEN NOT (focus_score * 1.25 BETWEEN 0.0 AND 1.0) THEN 'focus_score' END,
  CASE WHEN NOT (eye_visible_count + quality_grade - 1 BETWEEN 0 AND 2)
    THEN 'eye_visible_count' END) AS broken
FROM v_summary WHERE NOT (focus_score * 1.25 BETWEEN 0.0 AND 1.0)
  OR NOT (eye_visible_count + quality_grade - 1 BETWEEN 0 AND 2)"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the contract, after distorting two columns of every summary."""
    scored = scored_images(spark, sf_dir)
    warped = scored.withColumns(
        {
            "focus_score": F.col("focus_score") * 1.25,
            "eye_visible_count": F.col("eye_visible_count") + F.col("quality_grade") - 1,
        }
    )
    _, bad = SC.validate(warped, eyes=None)
    return bad.select("image_id", F.array_join("violations", ",").alias("broken"))


@query(
    """SELECT image_id, concat_ws(',', CASE WHEN bool_or(eye_idx = 1 AND image_id % 3 = 0)
    THEN 'bbox_norm' END,
  CASE WHEN bool_or(visibility = 'occluded') THEN 'visibility' END,
  CASE WHEN bool_or(image_id % 7 = 0) THEN 'eye_side' END,
  CASE WHEN bool_or(confidence * 1.3 > 1.0) THEN 'detection_confidence' END) AS broken
FROM v_eyes GROUP BY image_id HAVING bool_or(eye_idx = 1 AND image_id % 3 = 0)
  OR bool_or(visibility = 'occluded') OR bool_or(image_id % 7 = 0) OR bool_or(confidence * 1.3 > 1.0)"""
)
def contract_eye_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose eyes break the contract, after distorting four of their fields."""
    image = F.col("image_id")

    def warp(e):
        short = (e["eye_idx"] == 1) & (image % 3 == 0)
        box = F.when(short, F.slice(e["bbox_norm"], 1, 3)).otherwise(e["bbox_norm"])
        seen = F.when(e["visibility"] == "occluded", "covered").otherwise(e["visibility"])
        side = F.when(image % 7 == 0, F.upper(e["eye_side"])).otherwise(e["eye_side"])
        warped = {"bbox_norm": box, "visibility": seen, "eye_side": side}
        for name, value in warped.items():
            e = e.withField(name, value)
        return e.withField("detection_confidence", e["detection_confidence"] * 1.3)

    scored = scored_images(spark, sf_dir).withColumn("scored", F.transform("scored", warp))
    _, bad = SC.validate(scored)
    return bad.select("image_id", F.array_join("violations", ",").alias("broken"))


# --- downstream tables --------------------------------------------------------------------
@query("SELECT image_id FROM v_beside WHERE keyword IN ('wildlife', 'birds', 'animals')")
def keyword_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = X.image_list(spark, sf_dir)
    return DS.keyword_gate(images, X.beside(spark, sf_dir, "image_id", "keyword"))


@query(
    """SELECT s.image_id, round(s.focus_score, 6) AS focus_score,
  CASE WHEN b.ordered < TIMESTAMP '1998-06-01' THEN b.ordered ELSE TIMESTAMP '2002-01-01' END
    AS created_at, TIMESTAMP '2002-01-01' AS updated_at
FROM v_summary s JOIN v_beside b ON s.image_id = b.image_id"""
)
def upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run over all images onto a stored table that holds the older half of them."""
    old = X.beside(spark, sf_dir, "image_id", "base", "ordered").filter("ordered < '1998-06-01'")
    old = old.select(
        "image_id",
        F.col("base").alias("focus_score"),
        F.col("ordered").alias("created_at"),
        F.col("ordered").alias("updated_at"),
    )
    run_at = F.lit("2002-01-01").cast(old.schema["updated_at"].dataType)
    new = scored_images(spark, sf_dir).select("image_id", "focus_score")
    new = new.withColumns({"created_at": run_at, "updated_at": run_at})
    path = scratch_path(spark, "summary")
    DS.write_summary_table(old, path, buckets=16)
    DS.upsert_table(new, path, buckets=16)
    return spark.read.parquet(path).select(
        "image_id", F.round("focus_score", 6).alias("focus_score"), "created_at", "updated_at"
    )


@query(
    """SELECT image_id, 'eye_quality' AS model_name, round(focus_score, 6) AS score
FROM v_summary"""
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DS.model_scores(scored_images(spark, sf_dir))
    return rows.withColumn("score", F.round("score", 6))


@query(
    """SELECT b.image_id, round(CASE WHEN s.eye_visible_count > 0 AND s.confidence >= 0.45
  THEN b.base * 0.75 + s.focus_score * 0.25 ELSE b.base END, 6) AS final_score
FROM v_beside b LEFT JOIN v_summary s ON b.image_id = s.image_id"""
)
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = X.beside(spark, sf_dir, "image_id", "base")
    fused = DS.fuse_scores(base, scored_images(spark, sf_dir))
    return fused.select("image_id", F.round("final_score", 6).alias("final_score"))


@query(
    """SELECT b.stack_id, b.image_id, CAST(row_number() OVER (PARTITION BY b.stack_id
  ORDER BY CASE WHEN s.eye_visible_count > 0 THEN round(s.focus_score, 6) END DESC NULLS LAST,
    b.image_id) AS BIGINT) AS stack_rank
FROM v_beside b JOIN v_summary s ON b.image_id = s.image_id"""
)
def stack_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a burst from best to worst focus; frames without a graded eye come last."""
    scored = scored_images(spark, sf_dir)
    graded = F.when(F.col("eye_visible_count") > 0, F.round("focus_score", 6))
    frames = X.beside(spark, sf_dir, "image_id", "stack_id").join(
        scored.select("image_id", graded.alias("focus_score")), "image_id"
    )
    return DS.rank_in_stack(frames).select("stack_id", "image_id", "stack_rank")


__all__ = ["located", "metric_views", "moment_views", "rounded_summary", "summary_views"]
