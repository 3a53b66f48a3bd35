"""Per-eye metrics, image summaries and the result document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.constants import DEFAULT_GATES, Gates
from burstlens.functions import geometry as G
from burstlens.functions import scores as S
from burstlens.functions.names import crop_path
from burstlens.operators.crops import eye_windows, join_located, measure_eyes, with_shown_dims
from burstlens.operators.detections import (
    best_detection,
    flatten_best,
    gate_detections,
    subject_columns,
)
from burstlens.operators.localize import localization_notes, localize, notes
from burstlens.schemas import EYE_DETECTION, MOMENTS, RESULT

_MOMENT_NAMES = tuple(f.name for f in MOMENTS.fields)

# From images without pixels, with whatever was joined to them, to the same with their pixels.
Pixels = Callable[[DataFrame], DataFrame]

# What the summary needs to know about one eye, with its type.
EYE_FIELDS = {
    "eye_side": "string",
    "eye_idx": "int",
    "visibility": "string",
    "detection_confidence": "double",
    "bbox_norm": "array<double>",
    "sharpness_score": "double",
    "clarity_score": "double",
    "edge_energy": "double",
    "focus_score": "double",
    "noise_penalty": "double",
    "size_factor": "double",
    "failure_type": "string",
    "crop_path": "string",
    "crop_width_px": "int",
}


SCORED_COLUMNS = (
    "sharpness_score",
    "clarity_score",
    "edge_energy",
    "focus_score",
    "noise_penalty",
    "size_factor",
    "failure_type",
)


def score_crops(moments: DataFrame) -> DataFrame:
    """Adds the per-eye metrics and ``focus_score`` to rows of moments."""
    m = {name: F.col(name) for name in _MOMENT_NAMES}
    metrics = S.eye_metrics(m, F.col("crop_width_px"))
    parts = ("sharpness_score", "clarity_score", "edge_energy", "size_factor", "noise_penalty")
    return moments.withColumns(metrics).withColumn(
        "focus_score", S.fuse_focus(*[F.col(p) for p in parts])
    )


def nest_moments(moments: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per image, its moments in ``m0_*`` and ``m1_*`` columns.

    Plain ``max`` over at most one value per eye keeps the aggregate on primitive
    buffers, combines before the shuffle, and leaves the rows partitioned by image.
    """
    wide = [
        F.max(F.when(F.col("eye_idx") == i, F.col(name))).alias(f"m{i}_{name}")
        for i in range(len(C.EYE_SIDES))
        for name in _MOMENT_NAMES
    ]
    return moments.groupBy(key).agg(*wide)


def _scored_eye(i: int, path: Column) -> Column:
    """Scored struct of the eye with index ``i``, null if the image lacks it."""
    eye = F.filter("eyes", lambda e: e["eye_idx"] == i)
    eye = F.get(eye, F.lit(0))
    prefix = f"m{i}_"
    values = {name: F.col(prefix + name) for name in SCORED_COLUMNS}
    fields = {
        "eye_side": eye["eye_side"],
        "eye_idx": eye["eye_idx"],
        "visibility": eye["visibility"],
        "detection_confidence": eye["confidence"],
        "bbox_norm": eye["bbox_norm"],
        **values,
        "crop_path": F.when(F.col(prefix + "crop_width_px") > 0, path),
        "crop_width_px": F.col(prefix + "crop_width_px"),
    }
    struct = F.struct(*[fields[n].cast(t).alias(n) for n, t in EYE_FIELDS.items()])
    return F.when(eye.isNotNull(), struct)


def score_eyes(
    located: DataFrame,
    moments: DataFrame,
    key: str = "image_id",
    crop_base: str | None = None,
    path: Column | None = None,
) -> DataFrame:
    """Adds ``scored`` to located images, with the moments from a table of eyes.

    ``located`` and the nested moments are both partitioned by image, so this join adds no
    shuffle to ``located``.
    """
    joined = located.join(nest_moments(moments, key), key, "left")
    return _score_wide(joined, path if path is not None else F.col(key).cast("string"), crop_base)


def _score_wide(joined: DataFrame, path: Column, crop_base: str | None) -> DataFrame:
    """``eyes`` and ``m0_*``, ``m1_*`` columns to ``scored``; an eye without pixels is empty."""
    for i in range(len(C.EYE_SIDES)):
        prefix = f"m{i}_"
        sizes = (prefix + n for n in ("n_px", "crop_width_px", "crop_height_px"))
        joined = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sizes})
        m = {name: F.col(prefix + name) for name in _MOMENT_NAMES}
        metrics = S.eye_metrics(m, m["crop_width_px"])
        joined = joined.withColumns({prefix + n: c for n, c in metrics.items()})
        parts = ("sharpness_score", "clarity_score", "edge_energy", "size_factor", "noise_penalty")
        focus = S.fuse_focus(*[F.col(prefix + p) for p in parts])
        joined = joined.withColumn(prefix + "focus_score", focus)
    eyes = [
        _scored_eye(i, crop_path(crop_base, path, F.lit(side)))
        for i, side in enumerate(C.EYE_SIDES)
    ]
    scored = F.array_compact(F.array(*eyes))
    return joined.withColumn("scored", scored).drop(
        *[f"m{i}_{n}" for i in (0, 1) for n in _MOMENT_NAMES + SCORED_COLUMNS]
    )


def nest_eyes(per_eye: DataFrame, key: str = "image_id") -> DataFrame:
    """Long per-eye rows to one row per image with a ``scored`` array, left first."""
    struct = F.struct(*[F.col(n).cast(t).alias(n) for n, t in EYE_FIELDS.items()])
    slots = [
        F.max(F.when(F.col("eye_idx") == i, struct)).alias(f"_e{i}")
        for i in range(len(C.EYE_SIDES))
    ]
    wide = per_eye.groupBy(key).agg(*slots)
    scored = F.array_compact(F.array(*[F.col(f"_e{i}") for i in range(len(C.EYE_SIDES))]))
    return wide.select(key, scored.alias("scored"))


def visible_eyes(scored: Column) -> Column:
    return F.filter(scored, lambda e: S.scored_visibility(e["visibility"]))


def best_eye(scored: Column) -> Column:
    """Highest ``(focus, sharpness)`` among the visible eyes, the left one on a tie."""
    ranked = F.transform(
        visible_eyes(scored),
        lambda e: F.struct(
            e["focus_score"].alias("f"),
            e["sharpness_score"].alias("s"),
            (-e["eye_idx"]).alias("i"),
            e.alias("eye"),
        ),
    )
    return F.array_max(ranked)["eye"]


def summarize(
    scored: DataFrame, model_name: str = C.MODEL_NAME, model_version: str = C.MODEL_VERSION
) -> DataFrame:
    """Adds the ten summary columns from the ``scored`` array; local to a row.

    Images without a visible eye (or without any eye: null) get the empty summary.
    """
    eyes = F.coalesce(F.col("scored"), F.array().cast(_scored_type()))
    # A one-row generator binds the best eye: filters on the summary are not pushed below
    # it, where they would repeat the whole chain of formulas.
    chosen = F.struct(best_eye(eyes).alias("_best"), F.size(visible_eyes(eyes)).alias("_n"))
    df = scored.select("*", F.inline(F.array(chosen)))
    best = F.col("_best")
    df = df.withColumn(
        "_conf", S.gated_confidence(best["detection_confidence"], best["crop_width_px"])
    )
    found = best.isNotNull()

    def of_best(value: Column, fallback) -> Column:
        return F.when(found, value).otherwise(F.lit(fallback))

    return df.withColumns(
        {
            "best_eye_side": best["eye_side"],
            "eye_visible_count": F.col("_n"),
            "focus_score": of_best(best["focus_score"], 0.0),
            "sharpness_score": of_best(best["sharpness_score"], 0.0),
            "clarity_score": of_best(best["clarity_score"], 0.0),
            "quality_grade": of_best(S.gated_grade(best["focus_score"], F.col("_conf")), 0),
            "failure_type": of_best(S.failure_type(best, F.col("_conf")), "none"),
            "confidence": of_best(F.col("_conf"), 0.0),
            "model_name": F.lit(model_name),
            "model_version": F.lit(model_version),
        }
    ).drop("_n", "_best", "_conf")


SUMMARY_COLUMNS = (
    "best_eye_side",
    "eye_visible_count",
    "focus_score",
    "sharpness_score",
    "clarity_score",
    "quality_grade",
    "failure_type",
    "confidence",
    "model_name",
    "model_version",
)


def empty_result(
    images: DataFrame,
    notes: Sequence[str] = (C.NOTE_SKIPPED,),
    model_name: str = C.MODEL_NAME,
    model_version: str = C.MODEL_VERSION,
) -> DataFrame:
    """Default summary rows for skipped images, with their notes."""
    none = F.array().cast(_scored_type())
    rows = images.withColumn("scored", none)
    return summarize(rows, model_name, model_version).withColumn(
        "notes", F.array(*[F.lit(n) for n in notes])
    )


def _scored_type() -> str:
    return "array<struct<" + ", ".join(f"{n}: {t}" for n, t in EYE_FIELDS.items()) + ">>"


def score_images(
    images: DataFrame,
    detections: DataFrame,
    moments: DataFrame,
    key: str = "image_id",
    tie_break: Sequence[str] = ("det_idx",),
    gates: Gates = DEFAULT_GATES,
    crop_base: str | None = None,
    path: Column | None = None,
) -> DataFrame:
    """Images, flat detections and eye moments to one scored row per image.

    All three inputs meet partitioned by ``key``: one shuffle each, the detections cut
    to one row per image and task beforehand; everything after is local to a row.
    """
    located = localize(best_detection(gate_detections(detections, gates), key, tie_break), gates)
    narrow = located.select(key, "eyes", "pose_keypoints", *subject_columns())
    noted = localization_notes(images, narrow, key)
    return summarize(score_eyes(noted, moments, key, crop_base, path))


def score_photos(
    photos: DataFrame,
    detections: DataFrame,
    key: str = "image_id",
    tie_break: Sequence[str] = ("det_idx",),
    gates: Gates = DEFAULT_GATES,
    crop_base: str | None = None,
    path: Column | None = None,
    pixels: Pixels | None = None,
) -> DataFrame:
    """Images with pixels and flat detections to one scored row per image.

    ``photos`` has ``width, height, n_channels, orientation, data`` (stored, BGR); detections
    carry stored dims. The dims as displayed are joined first, without pixels. There is one
    join of the located rows to the photos; crops, measures and summary are local to the row,
    and the pixels are dropped as soon as the crops are cut. With ``pixels`` the photos come
    without ``n_channels`` and ``data``; it adds them behind the join, so no pixels move.
    """
    best = best_detection(gate_detections(detections, gates), key, tie_break)
    located = localize(with_shown_dims(best, photos, key), gates)
    narrow = eye_windows(located, F.col("image_width"), F.col("image_height")).select(
        key, "eyes", "windows", "pose_keypoints", *subject_columns(), F.lit(True).alias("_found")
    )
    joined = join_located(photos, narrow, key, "left")
    wide = _measured_wide(pixels(joined) if pixels else joined)
    noted = wide.withColumn("notes", notes(F.col("_found"), F.col("eyes"))).drop("_found")
    source = path if path is not None else F.col(key).cast("string")
    return summarize(_score_wide(noted, source, crop_base))


def _measured_wide(joined: DataFrame) -> DataFrame:
    """Images with ``windows``: the moments of both eyes as ``m0_*`` and ``m1_*``."""
    moments = [F.col(f"m{i}")[n].alias(f"m{i}_{n}") for i in (0, 1) for n in _MOMENT_NAMES]
    return measure_eyes(joined).select("*", *moments).drop("m0", "m1")


def _in_shown_dims(joined: DataFrame) -> DataFrame:
    """Adds the dims as displayed, as ``image_width`` and ``image_height``."""
    turn = F.when(F.col("orientation").between(1, 8), F.col("orientation")).otherwise(1)
    turned = joined.withColumn("orientation", turn.cast("int"))
    shown = G.oriented_dims(F.col("width"), F.col("height"), F.col("orientation"))
    return turned.withColumns({"image_width": shown["width"], "image_height": shown["height"]})


# What is known about the best detection of an image, besides the image itself.
_BEST_COLUMNS = ("x1", "y1", "x2", "y2", "bbox_confidence", "bbox_area_frac", "keypoints")


def score_files(
    images: DataFrame,
    detections: DataFrame | None = None,
    orientations: DataFrame | None = None,
    key: str = "path",
    tie_break: Sequence[str] = ("det_idx",),
    gates: Gates = DEFAULT_GATES,
    crop_base: str | None = None,
    pixels: Pixels | None = None,
) -> DataFrame:
    """Decoded image files (see ``sources.read_images``) to one scored row per file.

    ``detections`` are flat rows with the file's ``path``, in stored dims; without them each
    image row carries its own array of ``detections`` (see ``predict.with_detections``) and
    nothing is joined. ``orientations`` has ``path`` and ``orientation`` (unique by path); files
    without one, or with a value outside 1 to 8, are shown as stored.

    A file that cannot be decoded stays a row with ``error``, its summary and notes null. The
    small sides meet first; the files are decoded once and meet them in one hash join, and what
    needs an image's dims is judged after it, so dims cost no second decoding. With ``pixels`` and
    ``detections`` the files come by ``path`` only, and it decodes them behind the join (see
    ``sources.images.image_files``), so that no pixels move.
    """
    usable = F.coalesce(F.col("decoded"), F.lit(False))
    stored_dims = {"image_width": F.col("width"), "image_height": F.col("height")}
    if detections is not None:
        best = best_detection(gate_detections(detections, gates), key, tie_break)
        small = best.select(key, *_BEST_COLUMNS, F.lit(True).alias("_found"))
        if orientations is not None:
            small = small.join(orientations.select(key, "orientation"), key, "full")
        joined = join_located(images, small, key, "left")
        joined = pixels(joined) if pixels else joined
    else:
        boxes = F.when(usable, F.col("detections"))
        picked = flatten_best(
            images.withColumns(stored_dims).withColumn("detections", boxes), gates, keep_all=True
        )
        joined = picked.withColumn("_found", F.col("keypoints").isNotNull())
        if orientations is not None:
            joined = join_located(joined, orientations.select(key, "orientation"), key, "left")
    if orientations is None:
        joined = joined.withColumn("orientation", F.lit(1))
    located = localize(_in_shown_dims(joined), gates)
    found = F.coalesce(F.col("_found"), F.lit(False)) & usable
    located = located.select("*", *subject_columns())
    kept = ("eyes", "pose_keypoints", *SUBJECT_COLUMNS)
    eyes = {n: F.when(found, F.col(n)) for n in kept}
    windows = eye_windows(
        located.withColumns(eyes), F.col("image_width"), F.col("image_height")
    ).drop(*_BEST_COLUMNS, "det_idx", "head_width_px", "turned_away", "detections")
    wide = _measured_wide(windows)
    noted = wide.withColumn("notes", notes(F.when(found, True), F.col("eyes"))).drop("_found")
    scored = summarize(_score_wide(noted, F.col(key), crop_base))
    error = F.when(~usable, F.lit(C.ERROR_DECODE))
    held = {n: F.when(usable, F.col(n)) for n in (*SUMMARY_COLUMNS, "notes")}
    return scored.withColumns(held).withColumn("error", error)


def nest_located(eyes: DataFrame, key: str = "image_id") -> DataFrame:
    """Located eyes, one row each, to one row per image with an ``eyes`` array, left first.

    Of several eyes of one side the most confident one counts, then the one farther right and
    down; rows of another side than ``left`` and ``right`` do not count.
    """
    kinds = {
        "confidence": "double",
        "center_x": "double",
        "center_y": "double",
        "visibility": "string",
        "bbox_norm": "array<double>",
        "head_width_px": "double",
        "subject_area_frac": "double",
    }
    cells = [
        (F.col(n) if n in eyes.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()
    ]
    best = [
        F.max(F.when(F.col("eye_side") == side, F.struct(*cells))).alias(f"_e{i}")
        for i, side in enumerate(C.EYE_SIDES)
    ]
    named = [
        F.when(
            F.col(f"_e{i}").isNotNull(),
            F.struct(
                F.lit(side).alias("eye_side"),
                F.lit(i).alias("eye_idx"),
                *[F.col(f"_e{i}")[n].alias(n) for n in kinds],
            ),
        )
        for i, side in enumerate(C.EYE_SIDES)
    ]
    return eyes.groupBy(key).agg(*best).select(key, F.array_compact(F.array(*named)).alias("eyes"))


def score_located(
    photos: DataFrame,
    eyes: DataFrame,
    extras: DataFrame | None = None,
    key: str = "image_id",
    crop_base: str | None = None,
    path: Column | None = None,
    pixels: Pixels | None = None,
) -> DataFrame:
    """Images with pixels and eyes that somebody else has located to one scored row per image.

    ``eyes`` has ``eye_side, center_x, center_y, confidence, visibility, bbox_norm`` and
    ``head_width_px`` in displayed coordinates and is taken as it is: no gate, cascade or
    retention is applied, so eyes may be ``hidden`` or ``too_small``. ``extras`` may bring
    ``pose_keypoints`` and ``notes`` of an image. Images without an eye get the empty summary.
    ``pixels`` is as in ``score_photos``.
    """
    none = {
        "pose_keypoints": F.array().cast("array<array<double>>"),
        "notes": F.array().cast("array<string>"),
    }
    small = nest_located(eyes, key)
    if extras is not None:
        small = small.join(extras.select(key, *none), key, "full")
    else:
        small = small.withColumns(none)
    joined = _in_shown_dims(join_located(photos, small, key, "left"))
    windows = eye_windows(joined, F.col("image_width"), F.col("image_height"))
    wide = _measured_wide(pixels(windows) if pixels else windows).withColumns({n: F.coalesce(F.col(n), c) for n, c in none.items()})
    source = path if path is not None else F.col(key).cast("string")
    return summarize(_score_wide(wide, source, crop_base))


SUBJECT_COLUMNS = ("subject_bbox_norm", "subject_confidence")


def detections_array(scored: Column) -> Column:
    """All eyes of an image, visible or not, in the shape of the document."""
    return F.transform(
        scored,
        lambda e: F.struct(*[e[f.name].alias(f.name) for f in EYE_DETECTION.fields]),
    )


def crop_paths(scored: Column) -> Column:
    return F.filter(F.transform(scored, lambda e: e["crop_path"]), lambda p: p != "")


def to_result(scored: DataFrame, *keys: str) -> DataFrame:
    """The nested result document: summary, detections, debug, and the subject's box.

    Rows without the subject columns (eyes located elsewhere, skipped images) have nulls there.
    """
    subject = [
        (F.col(n) if n in scored.columns else F.lit(None)).alias(n) for n in SUBJECT_COLUMNS
    ]
    eyes = F.coalesce(F.col("scored"), F.array().cast(_scored_type()))
    rows = F.coalesce(F.col("pose_keypoints"), F.array().cast("array<array<double>>"))
    document = F.struct(
        F.struct(*SUMMARY_COLUMNS).alias(C.SUMMARY_FIELD),
        detections_array(eyes).alias("detections"),
        F.struct(
            crop_paths(eyes).alias("crop_paths"),
            rows.alias("pose_keypoints"),
            F.col("notes").alias("notes"),
        ).alias("debug"),
        *subject,
    )
    return scored.select(*keys, document.cast(RESULT).alias("result"))


def result_json(result: Column) -> Column:
    """The document as JSON text; null fields stay in it as ``null``."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def parse_result(text: Column) -> Column:
    return F.from_json(text, RESULT, {"mode": "FAILFAST"})


def violations(eyes: str | None = "scored") -> Column:
    """Names of the contract rules that a row breaks; only the best side and crop path may be null."""
    unit = lambda c: c.between(0.0, 1.0)
    in_unit = ("focus_score", "sharpness_score", "clarity_score", "confidence")
    rules = [(name, unit(F.col(name))) for name in in_unit]
    side = F.col("best_eye_side")
    rules += [
        ("eye_visible_count", F.col("eye_visible_count").between(0, 2)),
        ("quality_grade", F.col("quality_grade").between(0, 4)),
        ("failure_type", F.col("failure_type").isin(*C.FAILURE_TYPES)),
        ("best_eye_side", side.isNull() | side.isin(*C.EYE_SIDES)),
        ("model_name", F.col("model_name").isNotNull()),
        ("model_version", F.col("model_version").isNotNull()),
    ]
    if eyes is not None:

        def every_eye(test) -> Column:
            return F.forall(eyes, lambda e: F.coalesce(test(e), F.lit(False)))

        box = lambda e: (F.size(e["bbox_norm"]) == 4) & F.forall(e["bbox_norm"], lambda v: v.isNotNull())
        rules += [
            ("bbox_norm", every_eye(box)),
            ("visibility", every_eye(lambda e: e["visibility"].isin(*C.VISIBILITIES))),
            ("eye_side", every_eye(lambda e: e["eye_side"].isin(*C.EYE_SIDES))),
            ("detection_confidence", every_eye(lambda e: unit(e["detection_confidence"]))),
        ]
    rules = [(name, ~F.coalesce(holds, F.lit(False))) for name, holds in rules]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def validate(df: DataFrame, eyes: str | None = "scored") -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with their ``violations``."""
    checked = df.withColumn("violations", violations(eyes=eyes))
    good = checked.filter(F.size("violations") == 0).drop("violations")
    return good, checked.filter(F.size("violations") > 0)
