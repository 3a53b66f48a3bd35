"""Localiser hook: a user model from images to detections, and image files to summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.operators.scoring import score_files
from burstlens.schemas import DETECTION
from burstlens.sources.images import image_files, read_images

PredictFn = Callable[[pd.DataFrame], list[list[dict]]]

_DETECTIONS = f"array<{DETECTION.simpleString()}>"


def with_detections(
    images: DataFrame, make_predict_fn: Callable[[], PredictFn], batch_rows: int = 16
) -> DataFrame:
    """Adds ``detections`` (``array<struct>``, in the order the model gave them).

    ``make_predict_fn`` runs once per task and returns the model; the model takes at most
    ``batch_rows`` images at a time as ``data, width, height, n_channels`` and returns a list of
    detection dicts per image. ``det_idx`` is filled in from the order. Images without pixels
    (files that cannot be decoded) are not shown to the model and have no detections.
    ``session.build_session`` bounds the bytes of an Arrow batch, so whole images fit.
    """

    @F.pandas_udf(_DETECTIONS)
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = make_predict_fn()
        for data, width, height, channels in batches:
            batch = pd.DataFrame(
                {"data": data, "width": width, "height": height, "n_channels": channels}
            )
            answers: list[list[dict]] = [[] for _ in range(len(batch))]
            shown = (batch["data"].notna() & (batch["width"] > 0)).to_numpy().nonzero()[0]
            for lo in range(0, len(shown), batch_rows):
                rows = shown[lo : lo + batch_rows]
                found = model(batch.iloc[rows].reset_index(drop=True))
                for i, boxes in zip(rows, found, strict=True):
                    answers[i] = [{**d, "det_idx": n} for n, d in enumerate(boxes)]
            yield pd.Series(answers)

    return images.withColumn("detections", predict("data", "width", "height", "n_channels"))


def score_folder(
    spark: SparkSession,
    root: str,
    detections: DataFrame | None = None,
    orientations: DataFrame | None = None,
    make_predict_fn: Callable[[], PredictFn] | None = None,
    **options,
) -> DataFrame:
    """Image files below ``root`` to one scored row per file, in one call.

    Detections come from a table with the files' ``path`` or from a model; see
    ``scoring.score_files`` for the rows. With a table, files are decoded behind the join.
    """
    if (detections is None) == (make_predict_fn is None):
        raise ValueError("give either detections or make_predict_fn")
    if make_predict_fn is not None:
        images = with_detections(read_images(spark, root), make_predict_fn)
        return score_files(images, None, orientations, **options)
    files, decode = image_files(spark, root)
    return score_files(files, detections, orientations, pixels=decode, **options)
