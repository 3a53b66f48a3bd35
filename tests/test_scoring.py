"""Branches that the derived tables do not reach, on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.functions import geometry as G
from burstlens.functions import scores as S
from burstlens.functions.pixels import _blur, stack_moments
from burstlens.operators import crops as CR
from burstlens.operators import detections as D
from burstlens.operators import localize as L
from burstlens.operators import scoring as SC

EYE = {
    "eye_side": "left",
    "eye_idx": 0,
    "visibility": "visible",
    "detection_confidence": 0.9,
    "bbox_norm": [0.1, 0.1, 0.05, 0.05],
    "sharpness_score": 0.9,
    "clarity_score": 0.9,
    "edge_energy": 0.9,
    "focus_score": 0.9,
    "noise_penalty": 0.0,
    "size_factor": 1.0,
    "failure_type": "none",
    "crop_path": None,
    "crop_width_px": 48,
}


def summarize(spark, *images):
    """``images`` are lists of eye overrides."""
    schema = f"image_id bigint, scored {SC._scored_type()}"
    rows = [
        (i, [tuple({**EYE, **eye}[n] for n in SC.EYE_FIELDS) for eye in eyes])
        for i, eyes in enumerate(images)
    ]
    df = SC.summarize(spark.createDataFrame(rows, schema))
    return df.orderBy("image_id").collect()


def test_grades_and_gate(spark):
    focus = [0.9, 0.85, 0.7, 0.65, 0.5, 0.45, 0.3, 0.2, 0.1]
    rows = summarize(spark, *[[{"focus_score": f}] for f in focus])
    assert [r.quality_grade for r in rows] == [4, 4, 3, 3, 2, 2, 1, 1, 0]
    low = summarize(spark, *[[{"focus_score": f, "detection_confidence": 0.4}] for f in focus])
    assert [r.quality_grade for r in low] == [2, 2, 2, 2, 2, 2, 1, 1, 0]
    assert {r.failure_type for r in low} == {"none"}


def test_failure_cascade(spark):
    rows = summarize(
        spark,
        [{"size_factor": 0.3, "failure_type": "overexposed"}],
        [{"failure_type": "low_contrast", "focus_score": 0.1, "sharpness_score": 0.1}],
        [{"focus_score": 0.24, "sharpness_score": 0.1}],
        [{"focus_score": 0.19, "sharpness_score": 0.5}],
        [{"focus_score": 0.3, "noise_penalty": 0.7}],
        [{"focus_score": 0.1, "crop_width_px": 23, "detection_confidence": 0.8}],
    )
    assert [r.failure_type for r in rows] == [
        "subject_too_small", "low_contrast", "defocus", "motion_blur", "noise", "none",
    ]
    assert rows[5].confidence == pytest.approx(0.4)


def test_best_eye_ties_and_hidden_eyes(spark):
    right = {"eye_side": "right", "eye_idx": 1}
    rows = summarize(
        spark,
        [{}, right],
        [{}, {**right, "sharpness_score": 0.95}],
        [{"visibility": "turned_away"}, {**right, "focus_score": 0.1}],
        [{"visibility": "too_small"}, {**right, "visibility": "hidden"}],
        [],
        [{"visibility": "occluded", "focus_score": 0.3}],
    )
    assert [r.best_eye_side for r in rows] == ["left", "right", "right", None, None, "left"]
    assert [r.eye_visible_count for r in rows] == [2, 2, 1, 0, 0, 1]
    assert rows[3].focus_score == rows[4].confidence == 0.0
    assert {r.model_name for r in rows} == {C.MODEL_NAME}


def test_nest_eyes_matches_arrays(spark):
    schema = ", ".join(f"{n} {t}" for n, t in SC.EYE_FIELDS.items())
    rows = [
        (7, *[{**EYE, "eye_side": s, "eye_idx": i}[n] for n in SC.EYE_FIELDS])
        for i, s in ((1, "right"), (0, "left"))
    ]
    nested = SC.nest_eyes(spark.createDataFrame(rows, f"image_id bigint, {schema}")).collect()
    assert [[e.eye_side for e in r.scored] for r in nested] == [["left", "right"]]


def test_validate_splits_rows(spark):
    schema = f"image_id bigint, scored {SC._scored_type()}"
    eyes = [
        [{}],
        [{"bbox_norm": [0.1]}],
        [{"visibility": "asleep"}],
        [{"detection_confidence": 1.5}],
        [],
    ]
    rows = [
        (i, [tuple({**EYE, **e}[n] for n in SC.EYE_FIELDS) for e in es]) for i, es in enumerate(eyes)
    ]
    good, bad = SC.validate(SC.summarize(spark.createDataFrame(rows, schema)))
    assert {r.image_id for r in good.collect()} == {0, 4}
    broken = {r.image_id: set(r.violations) for r in bad.collect()}
    assert broken == {
        1: {"bbox_norm"},
        2: {"visibility"},
        3: {"detection_confidence", "confidence"},
    }


def test_nulls_break_the_contract(spark):
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SC.summarize(spark.createDataFrame([], f"scored {SC._scored_type()}")).schema if f.name != "scored")
    row = spark.range(1).select(*[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split(" ", 1)[0]) for f in fields.split(", ")])
    found = set(row.select(SC.violations(eyes=None).alias("v")).first().v)
    assert found == set(SC.SUMMARY_COLUMNS) - {"best_eye_side"}


def test_turned_photos_are_judged_as_displayed(spark):
    """A 100 x 50 photo is 50 x 100 if its axes are swapped; detections carry stored dims."""
    best = spark.createDataFrame([(o, 100, 50) for o in range(1, 9)], "image_id bigint, image_width bigint, image_height bigint")
    photos = best.select("image_id", F.lit(100).cast("bigint").alias("width"), F.lit(50).cast("bigint").alias("height"), F.col("image_id").cast("int").alias("orientation"))
    shown = {r.image_id: (r.image_width, r.image_height) for r in CR.with_shown_dims(best, photos).collect()}
    assert shown == {o: (50, 100) if o >= 5 else (100, 50) for o in range(1, 9)}


def test_too_small_branch(spark):
    """No head width reaches it under the default gates; nor under a larger crop gate."""
    gates = C.Gates(eye_crop_px=12)
    df = spark.createDataFrame([(5.0, 5.0, 0.4)], "x double, y double, confidence double")
    point = F.struct("x", "y", "confidence")
    args = (point, F.lit(16.0), F.lit(False), F.lit(100), F.lit(100), gates)
    row = df.select(G.eye_visibility(*args).alias("v")).first().v
    assert (row.visibility, row.confidence) == ("partially_visible", 0.4)
    kept = df.select(
        G.retained(F.lit("too_small"), F.lit(0.2)).alias("a"),
        G.retained(F.lit("too_small"), F.lit(0.3)).alias("b"),
        G.retained(F.lit("turned_away"), F.lit(0.0)).alias("c"),
    ).first()
    assert tuple(kept) == (False, True, True)


def test_short_keypoint_arrays(spark):
    """Missing keypoints: no eye rows for them, zeros in the debug rows."""
    schema = (
        "image_id bigint, det_idx bigint, x1 double, y1 double, x2 double, y2 double, "
        "bbox_confidence double, keypoints array<struct<x: double, y: double, confidence: double>>, "
        "image_width bigint, image_height bigint"
    )
    rows = [
        (1, 0, 0.0, 0.0, 100.0, 80.0, 0.9, [(50.0, 40.0, 0.9), (40.0, 30.0, 0.8)], 200, 100),
        (2, 0, 0.0, 0.0, 100.0, 80.0, 0.9, [], 200, 100),
        (3, 0, 0.0, 0.0, 100.0, 80.0, 0.9, [(1.0, 1.0, 0.1)] * 8, 200, 100),
    ]
    found = D.with_area(spark.createDataFrame(rows, schema))
    out = {r.image_id: r for r in L.localize(found).collect()}
    assert [e.eye_side for e in out[1].eyes] == ["left"]
    assert out[1].head_width_px == pytest.approx(40.0)
    assert out[1].pose_keypoints[2] == [0.0, 0.0, 0.0]
    assert out[2].eyes == [] and len(out[2].pose_keypoints) == 6
    assert out[3].eyes == [] and len(out[3].pose_keypoints) == 6
    assert D.keypoints_long(found).filter("image_id = 3").count() == 6


def test_nested_layout_equals_flat(spark, sf_dir):
    from burstlens.plans import fixtures as X

    flat = X.detections(spark, sf_dir).withColumn("det_idx", F.col("p") * 8 + F.col("det_idx"))
    fields = ["det_idx", "x1", "y1", "x2", "y2", "bbox_confidence", "keypoints"]
    nested = flat.groupBy("image_id", "image_width", "image_height").agg(
        F.collect_list(F.struct(*fields)).alias("detections")
    )
    a = D.best_detection(D.gate_detections(flat)).select("image_id", "det_idx", "bbox_area_frac")
    best = D.flatten_best(nested)
    b = best.select("image_id", "det_idx", "bbox_area_frac")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def _brute_moments(crop):
    h, w = crop.shape
    at = lambda y, x: int(crop[_fold(y, h), _fold(x, w)])
    taps = (0, 4, 21, 60, 86, 60, 21, 4, 0)
    half = len(taps) // 2
    lap, resid, grad = [], [], []
    for y in range(h):
        for x in range(w):
            lap.append(at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x))
            gx = sum((at(y + d, x + 1) - at(y + d, x - 1)) * (2 - abs(d)) for d in (-1, 0, 1))
            gy = sum((at(y + 1, x + d) - at(y - 1, x + d)) * (2 - abs(d)) for d in (-1, 0, 1))
            grad.append((gx * gx + gy * gy) ** 0.5)
            acc = sum(
                int(a) * int(b) * at(y + i - half, x + j - half)
                for i, a in enumerate(taps)
                for j, b in enumerate(taps)
            )
            resid.append(abs(at(y, x) - ((acc + 32768) >> 16)))
    return sum(lap), sum(v * v for v in lap), sum(grad), sum(resid)


def _fold(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


@pytest.mark.parametrize("shape", [(2, 2), (2, 9), (3, 4), (5, 3), (8, 8), (13, 24)])
def test_moments_against_brute_force(shape):
    crop = np.random.default_rng(sum(shape)).integers(0, 256, shape, dtype=np.uint8)
    m = stack_moments(crop[None])
    lap, lap2, grad, resid = _brute_moments(crop)
    assert (m["sum_lap"][0], m["sum_lap2"][0], m["sum_resid"][0]) == (lap, lap2, resid)
    assert m["sum_grad"][0] == pytest.approx(grad)
    assert m["sum_v"][0] == crop.sum(dtype=np.int64)


def test_blur_keeps_flat_areas():
    flat = np.full((1, 6, 6), 255, dtype=np.uint8)
    assert (_blur(flat) == 255).all()


def test_sharp_beats_flat(spark):
    ramp = np.tile(np.linspace(0, 225, 48).astype(np.uint8), (48, 1))
    noise = np.random.default_rng(0).integers(0, 30, (48, 48), dtype=np.uint8)
    flat = np.full((48, 48), 128, dtype=np.uint8)
    rows = [(0, bytes((ramp + noise).tobytes()), 48), (1, flat.tobytes(), 48), (2, b"\0", 0)]
    from burstlens.operators.crops import gray_crop_moments

    df = spark.createDataFrame(rows, "id bigint, gray binary, width int")
    out = {r.id: r for r in SC.score_crops(gray_crop_moments(df, "id")).collect()}
    assert out[0].sharpness_score > out[1].sharpness_score == 0.0
    assert out[0].edge_energy > out[1].edge_energy
    assert (out[2].size_factor, out[2].failure_type) == (0.0, "hidden_eye")


def test_size_factor(spark):
    widths = [0, 12, 23, 24, 36, 48, 90]
    df = spark.createDataFrame([(w,) for w in widths], "w int")
    got = [r[0] for r in df.select(S.size_factor(F.col("w"))).collect()]
    assert got == pytest.approx([0.0, 0.25, 23 / 48, 0.5, 0.75, 1.0, 1.0])
