"""Queries that write a source format to the shared folder and scan it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens import sources as R
from burstlens.plans import fixtures as X
from burstlens.plans.registry import query
from burstlens.session import scratch_path
from burstlens.sources.annotations import last_rows
from burstlens.sources.images import plain_path


@query("SELECT path FROM v_manifest")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank lines among them."""
    root = scratch_path(spark, "manifest")
    rows = X.beside(spark, sf_dir, "image_id", "path", "image_path")
    text = F.to_json(F.struct("path", "image_path", F.lit("x").alias("other")))
    gap = F.when(F.col("image_path").isNull(), F.lit("\n")).otherwise(F.lit(""))
    rows.select(F.concat(text, gap).alias("value")).write.text(root)
    return R.read_manifest(spark, root).select("path")


def _photo_id(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"part_(\d+)\.", 1).cast("bigint")


def _below(root: str) -> F.Column:
    base = plain_path(F.lit(root))
    return F.replace(F.col("path"), F.concat(base, F.lit("/")), F.lit(""))


@query("SELECT file, image_id FROM v_photos")
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files known by suffix; text files among them are left out."""

    def scan(root: str, lot: Column) -> DataFrame:
        listed = R.list_images(spark, root)
        return listed.select(_below(root).alias("file"), _photo_id(F.col("path")).alias("image_id"))

    return X.in_lots(spark, sf_dir, "listed", scan)


_ALL_BYTES = """printf('%02x%02x%02x', ((i % width) * (i // width) + image_id * 5) % 256,
  ((i % width) * 5 + (i // width) * 11 + image_id) % 256,
  ((i % width) * 7 + (i // width) * 3 + image_id * 11 + ((i % width) * (i // width)) % 13) % 256)"""


@query(
    f"""SELECT image_id, width, height, CAST(3 AS INTEGER) AS n_channels,
  md5(unhex(array_to_string([{_ALL_BYTES} for i in range(width * height)], ''))) AS body
FROM v_photos WHERE NOT broken"""
)
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded pixels of the image files."""

    def scan(root: str, lot: Column) -> DataFrame:
        return R.read_images(spark, root).filter("decoded").select(
            _photo_id(F.col("path")).alias("image_id"), "width", "height", "n_channels",
            F.md5("data").alias("body"),
        )

    return X.in_lots(spark, sf_dir, "scanned", scan)


@query("SELECT image_id, broken AS load_error FROM v_photos")
def load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files that cannot be decoded stay in the table, marked."""
    broken = ~F.coalesce(F.col("decoded"), F.lit(False))

    def scan(root: str, lot: Column) -> DataFrame:
        images = R.read_images(spark, root)
        return images.select(_photo_id(F.col("path")).alias("image_id"), broken.alias("load_error"))

    return X.in_lots(spark, sf_dir, "load-errors", scan)


@query(
    """SELECT 'parts' AS kind, part_id AS id, CAST(NULL AS BIGINT) AS pid,
  replace(raw_name, ' ', '_') AS name, CAST(NULL AS DOUBLE) AS n1, CAST(NULL AS DOUBLE) AS n2,
  CAST(NULL AS DOUBLE) AS n3, CAST(NULL AS DOUBLE) AS n4 FROM v_note_parts
UNION ALL SELECT 'images', image_id, NULL, file_name, NULL, NULL, NULL, NULL FROM v_note_images
UNION ALL SELECT 'boxes', image_id, NULL, NULL, box_x, box_y, box_w, box_h FROM v_note_boxes
UNION ALL SELECT 'locs', image_id, part_id, NULL, x, y, CAST(v AS DOUBLE), NULL FROM v_note_locs"""
)
def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four whitespace text tables, some lines of which are outdated, as one long table."""
    t = R.read_part_tables(spark, X.annotation_text(spark, sf_dir))
    t["locs"] = last_rows(t["locs"], "image_id", "part_id")
    none, nan = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    no_name = F.lit(None).cast("string")

    def row(frame, kind, key, pid=none, name=no_name, numbers=()):
        cells = [F.col(n).cast("double") for n in numbers] + [nan] * (4 - len(numbers))
        return frame.select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), pid.alias("pid"),
            name.alias("name"), *[c.alias(f"n{i}") for i, c in enumerate(cells, start=1)],
        )

    return (
        row(t["parts"], "parts", "part_id", name=F.col("part_name"))
        .unionByName(row(t["images"], "images", "image_id", name=F.col("file_name")))
        .unionByName(row(t["boxes"], "boxes", "image_id", numbers=("box_x", "box_y", "box_w", "box_h")))
        .unionByName(
            row(t["locs"], "locs", "image_id", pid=F.col("part_id"), numbers=("x", "y", "v"))
        )
    )
