"""Input tables of the registered queries, derived from the given tables.

The given tables hold no photos, so boxes, keypoints, crops, photos and annotations are
computed from their columns, row by row, over all rows. The same expression text serves
Spark and the checking SQL; only integer division and half-even rounding differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.constants import KEYPOINT_NAMES
from burstlens.plans.registry import view
from burstlens.session import scratch_path


def _spark(expr: str) -> str:
    return expr.replace(" DIV ", " div ").replace("RINT(", "rint(")


def _duck(expr: str) -> str:
    return expr.replace(" DIV ", " // ").replace("RINT(", "round_even(")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{_spark(e)} AS {n}" for n, e in columns.items()])


def _select(columns: dict[str, str], source: str) -> str:
    cells = ",\n  ".join(f"{_duck(e)} AS {n}" for n, e in columns.items())
    return f"SELECT {cells}\nFROM {source}"


# --- detections: one box per lineitem row --------------------------------------
_BOX_KEYS = {
    "image_id": "l_orderkey",
    "det_idx": "CAST(l_linenumber - 1 AS BIGINT)",
    "pk": "l_partkey",
    "sk": "l_suppkey",
    "p": "CAST(round(l_extendedprice * 100, 0) AS BIGINT)",
    "image_width": "640 + (l_orderkey % 5) * 160",
    "image_height": "480 + (l_orderkey % 3) * 120",
}
_BOX = {
    **{n: n for n in ("image_id", "det_idx", "pk", "sk", "p", "image_width", "image_height")},
    "bbox_confidence": "(p % 1000) / CAST(1000 AS DOUBLE)",
    "box_x": "CAST((p DIV 10) % image_width - 20 AS DOUBLE)",
    "box_y": "CAST((p DIV 100) % image_height - 20 AS DOUBLE)",
    "box_w": "CAST(8 + (pk * 7 + p) % 400 AS DOUBLE)",
    "box_h": "CAST(6 + (sk * 11 + p) % 300 AS DOUBLE)",
}
# Line numbers repeat within an order, so these complete the order of its boxes.
DETECTION_ORDER = ("det_idx", "pk", "sk", "p")


def _keypoint_exprs(k: str) -> dict[str, str]:
    """Keypoint number ``k`` of a box."""
    cent = "CAST(100 AS DOUBLE)"
    return {
        "x": f"box_x + box_w * ((pk * ({k} + 3) + sk * 7 + {k} * 29) % 101) / {cent}",
        "y": f"box_y + box_h * ((sk * ({k} + 5) + pk * 3 + {k} * 41) % 101) / {cent}",
        "confidence": f"CASE WHEN (pk + sk * {k} + {k}) % 7 = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE ((p DIV 7 + {k} * (137 + pk)) % 1000) / CAST(1000 AS DOUBLE) END",
    }


def _with_keypoints(boxes: DataFrame) -> DataFrame:
    points = []
    for k in range(len(KEYPOINT_NAMES)):
        fields = ", ".join(f"'{n}', {_spark(e)}" for n, e in _keypoint_exprs(str(k)).items())
        points.append(f"named_struct({fields})")
    return boxes.selectExpr(
        "image_id", "det_idx", "pk", "sk", "p", "image_width", "image_height",
        "bbox_confidence", "box_x AS x1", "box_y AS y1", "box_x + box_w AS x2",
        "box_y + box_h AS y2", f"array({', '.join(points)}) AS keypoints",
    )


def _keypoints_sql(source: str) -> str:
    cells = []
    for k, name in enumerate(KEYPOINT_NAMES):
        short = {"x": "x", "y": "y", "confidence": "c"}
        cells += [f"{_duck(e)} AS {name}_{short[n]}" for n, e in _keypoint_exprs(str(k)).items()]
    return (
        "SELECT image_id, det_idx, pk, sk, p, image_width, image_height, bbox_confidence, "
        "box_x AS x1, box_y AS y1, box_x + box_w AS x2, box_y + box_h AS y2,\n  "
        + ",\n  ".join(cells)
        + f"\nFROM {source}"
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _project(table(spark, sf_dir, "lineitem"), _BOX_KEYS)
    return _with_keypoints(_project(keyed, _BOX))


view("v_box_keys", _select(_BOX_KEYS, "lineitem"))
view("v_boxes", _select(_BOX, "v_box_keys"))
view("v_detections", _keypoints_sql("v_boxes"))


def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))


view("v_images", "SELECT o_orderkey AS image_id FROM orders")

# --- crops: one 8x8 gray grid per embedding -------------------------------------
_GRID = {
    "vec_id": "vec_id",
    "embedding": "embedding",
    "gain": "CASE vec_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 40 WHEN 2 THEN 150 WHEN 3 THEN 190 "
    "ELSE 700 END",
    "level": "CASE (vec_id DIV 5) % 5 WHEN 0 THEN 8 WHEN 1 THEN 60 WHEN 2 THEN 100 "
    "WHEN 3 THEN 128 ELSE 235 END",
    "slope": "CASE (vec_id DIV 25) % 4 WHEN 2 THEN 14 WHEN 3 THEN 25 ELSE 0 END",
    "shown_px": "CAST(12 + (vec_id * 7) % 48 AS INT)",
    "detection_confidence": "(300 + (vec_id * 37) % 701) / CAST(1000 AS DOUBLE)",
}


def gray_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, gray, width, shown_px, detection_confidence``; one byte per pixel.

    Every 20th vector gives a crop of one line, as an eye at the image border does.
    """
    grid = _project(table(spark, sf_dir, "embeddings"), _GRID)
    pixel = F.transform(
        "embedding",
        lambda e, i: F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(255.0),
                F.rint(
                    F.col("level")
                    + F.col("slope") * (i % 8 - 3)
                    + F.col("gain") * e.cast("double")
                ),
            ),
        ).cast("int"),
    )
    hexed = F.array_join(F.transform(pixel, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    width = F.when(F.col("vec_id") % 20 == 7, F.lit(64)).otherwise(F.lit(8))
    return grid.select(
        "vec_id", F.unhex(hexed).alias("gray"), width.alias("width"), "shown_px",
        "detection_confidence",
    )


view("v_grid", _select(_GRID, "embeddings"))
view(
    "v_crops",
    """SELECT vec_id AS key, CASE WHEN vec_id % 20 = 7 THEN 1 ELSE 8 END AS h,
  CASE WHEN vec_id % 20 = 7 THEN 64 ELSE 8 END AS w, shown_px, detection_confidence,
  [CAST(greatest(0, least(255, round_even(
      level + slope * (i % 8 - 3) + gain * CAST(embedding[i + 1] AS DOUBLE), 0))) AS BIGINT)
   for i in range(64)] AS g
FROM v_grid""",
)

# --- photos: one small BGR image per part ----------------------------------------
_PHOTO = {
    "image_id": "p_partkey",
    "width": "CAST(48 + (p_partkey % 5) * 8 AS INT)",
    "height": "CAST(40 + ((p_partkey DIV 5) % 3) * 8 AS INT)",
    "orientation": "CAST(1 + (p_partkey DIV 15) % 8 AS INT)",
    "broken": "p_size > 48",
    "file": "concat('lot_', p_partkey % 7, '/part_', p_partkey, "
    "CASE WHEN p_size < 3 THEN '.BMP' ELSE '.bmp' END)",
}


_PAINTED = 256
_LOT = 1_000_000  # photos that are on disk at a time, some 11 GB


def photo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), _PHOTO)


def _photo_schema(meta: DataFrame) -> str:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in meta.schema.fields)
    return f"{fields}, n_channels int, data binary"


def _painter():
    """Frames of ``photo_meta`` to frames with pixels, _PAINTED photos at a time."""
    painted = _PAINTED

    def paint(batches):
        import numpy as np

        plain = {}  # by dims, the pixels of a photo whose id is 0
        parts = (b.iloc[i : i + painted] for b in batches for i in range(0, len(b), painted))
        for pdf in parts:
            bodies = []
            for image_id, w, h in zip(pdf.image_id, pdf.width, pdf.height, strict=True):
                if (w, h) not in plain:
                    y, x = np.mgrid[0 : int(h), 0 : int(w)]
                    bgr = (x * y, x * 5 + y * 11, x * 7 + y * 3 + (x * y) % 13)
                    plain[w, h] = (np.stack(bgr, axis=-1) % 256).astype(np.uint8)
                shift = np.array([image_id * 5 % 256, image_id % 256, image_id * 11 % 256], np.uint8)
                bodies.append((plain[w, h] + shift).tobytes())  # bytes wrap at 256
            yield pdf.assign(n_channels=3, data=bodies)

    return paint


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with their pixels, as an image reader would deliver them (stored, BGR).

    The ids come from one small file; they are spread out before they turn into pixels, and a task
    holds the pixels of _PAINTED photos at a time.
    """
    meta = photo_meta(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return meta.mapInPandas(_painter(), _photo_schema(meta))


def with_pixels(rows: DataFrame) -> DataFrame:
    """Rows of ``photo_meta``, with whatever was joined to them, and the pixels of their photos."""
    paint = _painter()

    @F.pandas_udf("binary")
    def data(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for image_id, width, height in batches:
            ids = pd.DataFrame({"image_id": image_id, "width": width, "height": height})
            for painted in paint([ids]):
                yield painted["data"]

    pixels = data("image_id", "width", "height")
    return rows.withColumns({"n_channels": F.lit(3), "data": pixels})


def in_lots(
    spark: SparkSession, sf_dir: str, name: str, scan: Callable[[str, Column], DataFrame]
) -> DataFrame:
    """The rows that ``scan`` gets from all photos as files, of which at most _LOT are on disk at a time.

    ``scan`` gets the folder of a lot, and a condition on ``image_id`` that holds for the photos in it.
    The rows of all lots but the last are stored, then the files of the lot are dropped.
    """
    lots = max(1, -(-photo_meta(spark, sf_dir).count() // _LOT))
    table = scratch_path(spark, name)
    for lot in range(lots):
        mine = F.pmod("image_id", F.lit(lots)) == lot
        root = render_photos(spark, sf_dir, mine)
        rows = scan(root, mine)
        if lot < lots - 1:
            rows.write.mode("append").parquet(table)
            _drop(spark, root)
    return rows if lots == 1 else rows.unionByName(spark.read.schema(rows.schema).parquet(table))


def _drop(spark: SparkSession, root: str) -> None:
    """Removes the folder of a lot; tasks remove the folders in it."""
    from pyarrow import fs

    uri = root if "://" in root else f"file://{root}"

    def remove(batches):
        files, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch["path"]:
                if files.get_file_info(path).type == fs.FileType.Directory:
                    files.delete_dir(path)
            yield batch

    files, base = fs.FileSystem.from_uri(uri)
    below = [(i.path,) for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
    folders = spark.createDataFrame(below, "path string")
    folders.mapInPandas(remove, "path string").write.format("noop").mode("overwrite").save()
    files.delete_dir(base)


def render_photos(spark: SparkSession, sf_dir: str, mine: Column | None = None) -> str:
    """The photos (those of a lot) as bitmap files below a fresh folder of the shared file system.

    Broken photos get bytes that no decoder takes, and a text file beside them. A task paints and
    writes its photos in one pass, so no pixels leave it.
    """
    root = scratch_path(spark, "photos")
    paint = _painter()

    def save(batches):
        import struct

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made = set()
        for pdf in paint(batches):
            for row in pdf.itertuples(index=False):
                path = f"{base}/{row.file}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                body, width, height = row.data, int(row.width), int(row.height)
                # Bitmap lines run from the bottom up; these widths need no padding.
                line = width * 3
                lines = [body[i : i + line] for i in range(0, len(body), line)]
                head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
                info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0)
                with files.open_output_stream(path) as out:
                    out.write(b"broken" if row.broken else head + info + b"".join(lines[::-1]))
                if row.broken:
                    with files.open_output_stream(path.rsplit(".", 1)[0] + ".txt") as out:
                        out.write(b"cannot be read")
            yield pdf[["image_id"]]

    some = photo_meta(spark, sf_dir).filter(F.lit(True) if mine is None else mine)
    meta = some.repartition(spark.sparkContext.defaultParallelism)
    written = meta.mapInPandas(save, "image_id bigint")
    written.write.format("noop").mode("overwrite").save()
    return root


view("v_photos", _select(_PHOTO, "part"))
view(
    "v_displayed",
    """SELECT *, CASE WHEN orientation >= 5 THEN height ELSE width END AS dw,
  CASE WHEN orientation >= 5 THEN width ELSE height END AS dh FROM v_photos""",
)


def stored_xy(u: str, v: str) -> tuple[str, str]:
    """SQL for the stored pixel behind the displayed pixel ``(u, v)``."""
    x = (
        f"CASE orientation WHEN 2 THEN width - 1 - {u} WHEN 3 THEN width - 1 - {u} "
        f"WHEN 5 THEN {v} WHEN 6 THEN {v} WHEN 7 THEN width - 1 - {v} "
        f"WHEN 8 THEN width - 1 - {v} ELSE {u} END"
    )
    y = (
        f"CASE orientation WHEN 3 THEN height - 1 - {v} WHEN 4 THEN height - 1 - {v} "
        f"WHEN 5 THEN {u} WHEN 6 THEN height - 1 - {u} WHEN 7 THEN height - 1 - {u} "
        f"WHEN 8 THEN {u} ELSE {v} END"
    )
    return x, y


# SQL for the gray value of the stored pixel (sx, sy).
GRAY_SQL = """((9798 * ((sx * 7 + sy * 3 + image_id * 11 + (sx * sy) % 13) % 256)
  + 19235 * ((sx * 5 + sy * 11 + image_id) % 256)
  + 3735 * ((sx * sy + image_id * 5) % 256) + 16384) >> 15)"""

# Detections on photos: lineitem rows by part, in displayed photo coordinates.
_PHOTO_BOX_KEYS = {
    "image_id": "l_partkey",
    "det_idx": "CAST(l_linenumber - 1 AS BIGINT)",
    "pk": "l_orderkey",
    "sk": "l_suppkey",
    "p": "CAST(round(l_extendedprice * 100, 0) AS BIGINT)",
    "width": "48 + (l_partkey % 5) * 8",
    "height": "40 + ((l_partkey DIV 5) % 3) * 8",
    "orientation": "1 + (l_partkey DIV 15) % 8",
}
_PHOTO_BOX = {
    **{n: n for n in ("image_id", "det_idx", "pk", "sk", "p")},
    "image_width": "CASE WHEN orientation >= 5 THEN height ELSE width END",
    "image_height": "CASE WHEN orientation >= 5 THEN width ELSE height END",
    "bbox_confidence": "(p % 1000) / CAST(1000 AS DOUBLE)",
    "box_x": "CAST((p DIV 10) % 24 - 4 AS DOUBLE)",
    "box_y": "CAST((p DIV 100) % 20 - 4 AS DOUBLE)",
    "box_w": "CAST(8 + (pk * 7 + p) % 44 AS DOUBLE)",
    "box_h": "CAST(6 + (sk * 11 + p) % 36 AS DOUBLE)",
}


def photo_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _project(table(spark, sf_dir, "lineitem"), _PHOTO_BOX_KEYS)
    # Detectors report stored dims; the SQL side has the displayed ones.
    stored = _PHOTO_BOX | {"image_width": "width", "image_height": "height"}
    return _with_keypoints(_project(keyed, stored))


view("v_photo_box_keys", _select(_PHOTO_BOX_KEYS, "lineitem"))
view("v_photo_boxes", _select(_PHOTO_BOX, "v_photo_box_keys"))
view("v_photo_detections", _keypoints_sql("v_photo_boxes"))

# Eyes that somebody else has located: of the photos, in displayed coordinates.
_GIVEN_SHOWN = {
    "image_id": "image_id",
    "dw": "CASE WHEN orientation >= 5 THEN height ELSE width END",
    "dh": "CASE WHEN orientation >= 5 THEN width ELSE height END",
    "eye_idx": "eye_idx",
}
_GIVEN_EYE = {
    "image_id": "image_id",
    "eye_idx": "eye_idx",
    "eye_side": "CASE eye_idx WHEN 0 THEN 'left' ELSE 'right' END",
    "center_x": "(image_id * 7 + eye_idx * 13) % (dw + 6) - CAST(3 AS DOUBLE)",
    "center_y": "(image_id * 11 + eye_idx * 5) % (dh + 6) - CAST(2.5 AS DOUBLE)",
    "confidence": "(image_id * 37 + eye_idx * 291) % 1001 / CAST(1000 AS DOUBLE)",
    "visibility": "CASE (image_id + eye_idx * 2) % 8 WHEN 0 THEN 'hidden' WHEN 1 THEN 'too_small' "
    "WHEN 2 THEN 'turned_away' WHEN 3 THEN 'partially_visible' WHEN 4 THEN 'occluded' "
    "ELSE 'visible' END",
    "head_width_px": "40 + (image_id * 3 + eye_idx * 17) % 160 / CAST(2 AS DOUBLE)",
}
_GIVEN_EXISTS = "(image_id + eye_idx) % 5 <> 0"


def given_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two eyes per photo, some photos without any, in no order."""
    sides = F.explode(F.array(F.lit(1), F.lit(0))).alias("eye_idx")
    shown = photo_meta(spark, sf_dir).select("*", sides).filter(_GIVEN_EXISTS)
    eyes = _project(_project(shown, _GIVEN_SHOWN), _GIVEN_EYE)
    return eyes.drop("eye_idx").withColumn("bbox_norm", F.array(*[F.lit(0.25)] * 4))


view(
    "v_given_shown",
    _select(
        _GIVEN_SHOWN,
        f"(SELECT *, unnest([0, 1]) AS eye_idx FROM v_photos) WHERE {_GIVEN_EXISTS}",
    ),
)
GIVEN_EYES_SQL = _select(_GIVEN_EYE, "v_given_shown")

# --- annotation tables, from orders -----------------------------------------------
_NOTES_IMAGE = {
    "image_id": "o_orderkey",
    "file_name": "concat('G', o_custkey % 50, '/img_', o_orderkey, '.jpg')",
    "width": "200 + o_orderkey % 7 * 50",
    "height": "150 + o_orderkey % 5 * 50",
    "total": "o_totalprice",
    "ordered": "o_orderdate",
    "status": "o_orderstatus",
}
_NOTES_BOX = {
    "image_id": "o_orderkey",
    "box_x": "CAST(5 + o_orderkey % 40 AS DOUBLE)",
    "box_y": "CAST(4 + o_orderkey % 30 AS DOUBLE)",
    "box_w": "CAST(CASE WHEN o_orderkey % 17 = 0 THEN 6 ELSE 60 + o_orderkey % 90 END AS DOUBLE)",
    "box_h": "CAST(CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 50 + o_orderkey % 70 END AS DOUBLE)",
}
# Some files are missing, some images have no box, some parts have no row.
_FILE_EXISTS = "total >= 16000"
_BOX_EXISTS = "o_orderdate >= TIMESTAMP '1995-05-01'"
_PART_EXISTS = "day(o_orderdate) <> pid + 10"

# --- fixed values: part vocabulary of the annotation tables -------------------------
PARTS = (
    "back",
    "beak",
    "belly",
    "breast",
    "crown",
    "forehead",
    "left eye",
    "left leg",
    "left wing",
    "nape",
    "right eye",
    "right leg",
    "right wing",
    "tail",
    "throat",
)
_NOTES_LOC = {
    "image_id": "image_id",
    "part_id": "pid",
    "x": "CASE WHEN v = 1 THEN CAST(5 + image_id % 40 + (image_id * (pid + 3)) % 60 AS DOUBLE) "
    "ELSE CAST(0 AS DOUBLE) END",
    "y": "CASE WHEN v = 1 THEN CAST(4 + image_id % 30 + (image_id * (pid + 5)) % 50 AS DOUBLE) "
    "ELSE CAST(0 AS DOUBLE) END",
    "v": "v",
}
_PART_SHOWN = (
    "CASE WHEN ((o_orderkey DIV 3) * (pid + 11) + pid * pid * 17 + o_orderkey) % 7 < 3 "
    "THEN 1 ELSE 0 END"
)


def annotation_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _project(table(spark, sf_dir, "orders"), _NOTES_IMAGE)
    return images.select("image_id", "file_name")


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that exist, with their pixel dims."""
    images = _project(table(spark, sf_dir, "orders"), _NOTES_IMAGE)
    return images.filter(_FILE_EXISTS).select("file_name", "width", "height")


def annotation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders").filter(_BOX_EXISTS), _NOTES_BOX)


def annotation_parts(spark: SparkSession) -> DataFrame:
    """The raw part vocabulary."""
    rows = list(enumerate(PARTS, start=1))
    return spark.createDataFrame(rows, "part_id bigint, raw_name string")


def annotation_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pids = F.explode(F.sequence(F.lit(1), F.lit(len(PARTS)))).alias("pid")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", pids)
    shown = rows.withColumn("pid", F.col("pid").cast("bigint")).filter(_PART_EXISTS)
    marked = shown.selectExpr("o_orderkey AS image_id", "pid", f"{_spark(_PART_SHOWN)} AS v")
    return _project(marked, _NOTES_LOC)


def annotation_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from burstlens.functions.names import normalize_name

    parts = annotation_parts(spark).select(
        "part_id", normalize_name(F.col("raw_name")).alias("part_name")
    )
    return {
        "parts": parts,
        "images": annotation_images(spark, sf_dir),
        "boxes": annotation_boxes(spark, sf_dir),
        "locs": annotation_locs(spark, sf_dir),
    }


def _line(*columns: str) -> Column:
    """Columns as one whitespace-separated line, with stray blanks."""
    cells = [F.col(c).cast("string") for c in columns]
    return F.concat(F.lit(" "), F.concat_ws("  ", *cells), F.lit(" "))


def annotation_text(spark: SparkSession, sf_dir: str) -> str:
    """The four annotation tables as text files below a fresh folder.

    Some ids stand in a file twice: a stale line, then the one that counts.
    """
    from burstlens.sources.annotations import PART_FILES

    root = scratch_path(spark, "parts")
    tables = {
        "parts": (annotation_parts(spark), "part_id", ("part_id",), ("raw_name",), "no part"),
        "images": (
            annotation_images(spark, sf_dir), "image_id", ("image_id",), ("file_name",), "gone.jpg",
        ),
        "boxes": (
            annotation_boxes(spark, sf_dir), "image_id", ("image_id",),
            ("box_x", "box_y", "box_w", "box_h"), "1 2 3 4",
        ),
        "locs": (
            annotation_locs(spark, sf_dir), "image_id", ("image_id", "part_id"), ("x", "y", "v"),
            "9 9 1",
        ),
    }
    for name, (frame, key, ids, values, stale) in tables.items():
        line = _line(*ids, *values)
        before = F.concat(_line(*ids), F.lit(f" {stale}\n\n"), line)
        text = F.when(F.col(key) % 11 == 3, before).otherwise(line)
        frame.select(text.alias("value")).write.text(f"{root}/{PART_FILES[name]}")
    return root


view("v_note_rows", _select(_NOTES_IMAGE, "orders"))
view("v_note_images", "SELECT image_id, file_name FROM v_note_rows")
view("v_note_files", f"SELECT file_name, width, height FROM v_note_rows WHERE {_FILE_EXISTS}")
view("v_note_boxes", _select(_NOTES_BOX, f"orders WHERE {_BOX_EXISTS}"))
view(
    "v_note_parts",
    "SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({i} AS BIGINT), '{n}')" for i, n in enumerate(PARTS, start=1))
    + ") t(part_id, raw_name)",
)
view(
    "v_note_marks",
    f"""SELECT o_orderkey AS image_id, pid, {_duck(_PART_SHOWN)} AS v
FROM (SELECT o_orderkey, o_orderdate, unnest(range(1, {len(PARTS) + 1})) AS pid FROM orders)
WHERE {_PART_EXISTS}""",
)
view("v_note_locs", _select(_NOTES_LOC, "v_note_marks"))

# --- small tables beside the images -------------------------------------------------
_BESIDE = {
    "image_id": "o_orderkey",
    "stack_id": "o_custkey",
    "base": "(o_orderkey * 13 % 1001) / CAST(1000 AS DOUBLE)",
    "keyword": "CASE o_orderkey % 5 WHEN 0 THEN 'wildlife' WHEN 1 THEN 'birds' "
    "WHEN 2 THEN 'animals' WHEN 3 THEN 'people' ELSE 'city' END",
    "path": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' "
    "ELSE concat('img/', o_orderkey, '.jpg') END",
    "image_path": "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' "
    "ELSE concat('alt/', o_orderkey, '.jpg') END",
    "total": "o_totalprice",
    "ordered": "o_orderdate",
}


def beside(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), _BESIDE).select(*columns)


view("v_beside", _select(_BESIDE, "orders"))
