"""Scores as column expressions over crop moments, and the image-level rules.

Every function takes columns, so all of it stays inside whole-stage codegen; the only
Python work is the pixel pass that produces the moments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens import constants as C


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def population_variance(n: Column, total: Column, squares: Column) -> Column:
    """``(n*Sxx - Sx^2) / n^2`` over integer sums, never below zero."""
    n_d, s, s2 = n.cast("double"), total.cast("double"), squares.cast("double")
    return F.greatest(F.lit(0.0), (n_d * s2 - s * s) / (n_d * n_d))


def degenerate(m: Column) -> Column:
    """Crops without pixels, or with a side below two pixels, carry no signal."""
    return (m["n_px"] < 1) | (m["crop_height_px"] < 2) | (m["crop_width_px"] < 2)


def sharpness(m: Column) -> Column:
    return clip01(population_variance(m["n_px"], m["sum_lap"], m["sum_lap2"]) / C.LAPLACIAN_CAP)


def clarity(m: Column) -> Column:
    return clip01(F.sqrt(population_variance(m["n_px"], m["sum_v"], m["sum_v2"])) / C.CLARITY_CAP)


def edge_energy(m: Column) -> Column:
    return clip01(m["sum_grad"] / m["n_px"] / C.EDGE_CAP)


def noise_penalty(m: Column) -> Column:
    return clip01(m["sum_resid"].cast("double") / m["n_px"] / C.NOISE_CAP)


def size_factor(width_px: Column) -> Column:
    return (
        F.when(width_px <= 0, F.lit(0.0))
        .when(width_px < C.USABLE_CROP_PX, width_px / F.lit(float(C.USABLE_CROP_PX)) * 0.5)
        .otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), width_px / F.lit(C.FULL_SIZE_PX))))
    )


def exposure_failure(m: Column) -> Column:
    mean = m["sum_v"].cast("double") / m["n_px"]
    bright = m["n_bright"].cast("double") / m["n_px"]
    dark = m["n_dark"].cast("double") / m["n_px"]
    return (
        F.when((mean > C.BRIGHT_MEAN) | (bright > C.BRIGHT_SHARE), F.lit("overexposed"))
        .when((mean < C.DARK_MEAN) | (dark > C.DARK_SHARE), F.lit("low_contrast"))
        .otherwise(F.lit("none"))
    )


def eye_metrics(m: Column, width_px: Column) -> dict[str, Column]:
    """All per-eye metrics of one crop, with the degenerate case folded in."""
    bad = degenerate(m)

    def unless_bad(value: Column, fallback) -> Column:
        return F.when(bad, F.lit(fallback)).otherwise(value)

    return {
        "sharpness_score": unless_bad(sharpness(m), 0.0),
        "clarity_score": unless_bad(clarity(m), 0.0),
        "edge_energy": unless_bad(edge_energy(m), 0.0),
        "noise_penalty": unless_bad(noise_penalty(m), 1.0),
        "size_factor": unless_bad(size_factor(width_px), 0.0),
        "failure_type": unless_bad(exposure_failure(m), "hidden_eye"),
    }


def fuse_focus(sharp: Column, clear: Column, edge: Column, size: Column, noise: Column) -> Column:
    w = C.FOCUS_WEIGHTS
    raw = (
        F.lit(w["sharpness_score"]) * sharp
        + F.lit(w["clarity_score"]) * clear
        + F.lit(w["edge_energy"]) * edge
    )
    return clip01(raw * size * F.greatest(F.lit(0.0), 1.0 - noise))


def quality_grade(focus: Column) -> Column:
    grade = F.lit(0)
    for value, cut in reversed(C.GRADE_CUTS):
        grade = F.when(focus >= cut, F.lit(value)).otherwise(grade)
    return grade


def blur_failure(focus: Column, sharp: Column) -> Column:
    return (
        F.when((sharp < C.DEFOCUS_SHARPNESS) & (focus < C.DEFOCUS_FOCUS), F.lit("defocus"))
        .when(focus < C.MOTION_FOCUS, F.lit("motion_blur"))
        .otherwise(F.lit("none"))
    )


def gated_confidence(confidence: Column, width_px: Column) -> Column:
    return F.when(width_px < C.USABLE_CROP_PX, confidence * C.SMALL_CROP_FACTOR).otherwise(
        confidence
    )


def failure_type(best: Column, confidence: Column) -> Column:
    """Failure of the best eye; nothing is asserted below the confidence gate."""
    blur = blur_failure(best["focus_score"], best["sharpness_score"])
    small = (best["visibility"] == "too_small") | (best["size_factor"] < C.SMALL_SUBJECT_FACTOR)
    return (
        F.when(confidence < C.CONFIDENCE_GATE, F.lit("none"))
        .when(best["visibility"] == "turned_away", F.lit("turned_away"))
        .when(small, F.lit("subject_too_small"))
        .when(best["failure_type"] != "none", best["failure_type"])
        .when(blur != "none", blur)
        .when(best["noise_penalty"] > C.NOISE_LIMIT, F.lit("noise"))
        .otherwise(F.lit("none"))
    )


def gated_grade(focus: Column, confidence: Column) -> Column:
    grade = quality_grade(focus)
    return F.when(
        confidence < C.CONFIDENCE_GATE, F.least(grade, F.lit(C.CAPPED_GRADE))
    ).otherwise(grade)


def scored_visibility(visibility: Column) -> Column:
    """Eyes that count for the image: everything but hidden, too small, turned away."""
    return ~visibility.isin(*C.NOT_SCORED_VISIBILITIES)
