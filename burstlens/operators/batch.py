"""Batch scoring: a manifest in, one result or error row per line out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.operators.scoring import to_result


def score_batch(manifest: DataFrame, listing: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per manifest line: ``result``, or ``error`` where there is none.

    ``listing`` holds the files that exist (unique ``path``) and ``scored`` the scored
    images with their ``path`` (unique) and ``decoded``. An image is scored once however
    many lines name it; adaptive skew join splits a path that very many lines name. Failures
    become rows, so one bad image does not lose the batch: a file that is missing, that cannot
    be decoded (``decoded`` is false), or that ``scored`` does not know.
    """
    whole = F.coalesce(F.col("decoded"), F.lit(False))
    results = to_result(scored.withColumn("_decoded", whole), "path", "_decoded")
    known = listing.select("path", F.lit(True).alias("_exists")).join(results, "path", "left")
    rows = manifest.join(known, "path", "left")
    error = (
        F.when(F.col("_exists").isNull(), F.lit(C.ERROR_MISSING))
        .when(F.col("_decoded").isNull(), F.lit(C.ERROR_NOT_SCORED))
        .when(~F.col("_decoded"), F.lit(C.ERROR_DECODE))
    )
    return rows.select(
        *manifest.columns, error.alias("error"), F.when(error.isNull(), F.col("result")).alias("result")
    )


def batch_records(rows: DataFrame) -> DataFrame:
    """JSON text per line: ``{path, error}`` or ``{path, ...document}``."""
    failed = F.to_json(F.struct("path", "error"))
    whole = F.to_json(F.struct("path", "result.*"), {"ignoreNullFields": "false"})
    return rows.withColumn("record", F.when(F.col("error").isNotNull(), failed).otherwise(whole))
