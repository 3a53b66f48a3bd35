"""Annotation sources: whitespace text tables, COCO keypoint JSON, annotation CSV."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstlens.functions.names import normalize_name, strip
from burstlens.schemas import COCO_ANNOTATION, COCO_DOCUMENT, COCO_IMAGE, PLACE, PLACE_BITS
from burstlens.sources.images import plain_path_text

# File names of the four annotation tables below their root.
PART_FILES = {
    "parts": "parts/parts.txt",
    "images": "images.txt",
    "boxes": "bounding_boxes.txt",
    "locs": "parts/part_locs.txt",
}


_ROW_BITS, _BLOCK_BITS = 33, 53  # of a line's number in its block, and of a block's start
_MOST_PACKED = 1 << 16  # files whose lines get a long as place
_PACKED = 4  # a task may read so many blocks of one size before packed places could meet


def _file_key(uri: Column) -> Column:
    """``plain_path`` without a regular expression, as it runs for every line."""
    rest = F.concat(F.lit("/"), F.ltrim(F.substring(uri, 6, 1 << 30), F.lit("/")))
    usual = uri.startswith("file:///") & ~uri.startswith("file:////")
    cut = F.when(usual, F.substring(uri, 8, 1 << 30)).when(uri.startswith("file:/"), rest)
    return cut.otherwise(uri)


def _packed_place(n_files: int) -> Column:
    """``place`` as a long of ``PLACE_BITS``: the file, then the block's start and the line's number.

    Lines are counted over a task, so a block that other blocks of the task precede counts on from
    them. The last block of a file may do so; another one must stay below the start of the next,
    which Spark's packing (full blocks first) gives, and which is checked.
    """
    shift = PLACE_BITS - n_files.bit_length()
    spot = F.col("_start") * _PACKED + F.col("_row")
    apart = (F.col("_start") + F.col("_length") >= F.col("_size")) | (
        F.col("_row") < F.col("_length") * _PACKED
    )
    lost = F.raise_error(F.lit("lines cannot be told apart by place: spark.sql.files.maxPartitionNum is too low"))
    packed = F.shiftleft(F.col("_nth"), shift) + spot
    return F.when(apart & (spot < F.lit(1 << shift)), packed).otherwise(lost.cast("bigint"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their ``place``: a number that grows along a file and over files by name.

    It is made of file, block start and line number in the block, so no line waits for another: a
    long whose metadata tell its ``bits``, or a decimal for more than 65,535 files.
    The table of files that this looks up is the list of files that Spark makes to read them.
    """
    lines = spark.read.text(path)
    files = [(plain_path_text(f),) for f in lines.inputFiles()]
    named = [(name, i) for i, (name,) in enumerate(sorted(files))]
    order = spark.createDataFrame(named, "_file string, _nth bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    spots = lines.select(
        "value",
        _file_key(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.col("_metadata.file_size").alias("_size"),
        row.alias("_row"),
    )
    joined = spots.join(F.broadcast(order), "_file")
    if len(named) < _MOST_PACKED:
        return joined.select("value", _packed_place(len(named)).alias("place", metadata={"bits": PLACE_BITS}))
    wide = lambda c, bits: c.cast("decimal(12,0)") * F.lit(Decimal(1 << bits))
    start = F.col("_start").cast("decimal(16,0)") * F.lit(Decimal(1 << _ROW_BITS))
    place = wide(F.col("_nth"), _ROW_BITS + _BLOCK_BITS) + start + F.col("_row")
    return joined.select("value", place.cast(PLACE).alias("place"))


def last_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key by ``place``, which the result lacks.

    Each value is kept by its place in an aggregate that combines before the shuffle, so a key
    with very many rows sends one row from each task.
    """
    values = [c for c in rows.columns if c not in (*keys, "place")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "place").alias(c) for c in values])


def _stripped(text: Column) -> Column:
    """``strip``, whose regular expression only runs where a line ends in a mark of its own kind."""
    cut = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.right(cut, F.lit(1)).isin("\x85", "\u2028", "\u2029"), strip(cut)).otherwise(cut)


def _fields(lines: DataFrame, n: int, numbers: bool = False) -> tuple[DataFrame, list[Column], list[str]]:
    """Non-blank lines split at whitespace into at most ``n`` fields, and the columns to keep.

    Fields that are all ``numbers`` may lose blanks: lines of one or two blanks between fields then
    split at a blank, without a regular expression.
    """
    text = _stripped(F.col("value"))
    others = [c for c in lines.columns if c != "value"]
    fields = F.split(text, r"\s+", n)
    if numbers:
        single = F.replace(text, F.lit("  "), F.lit(" "))
        odd = F.contains(single, F.lit("  "))
        for mark in "\t\n\x0b\f\r":
            odd = odd | F.contains(text, F.lit(mark))
        fields = F.when(odd, fields).otherwise(F.split(single, " ", n))
    kept = lines.filter(text != "").select(fields.alias("f"), *others)
    return kept, [F.col("f")[i] for i in range(n)], others


def parse_parts(lines: DataFrame) -> DataFrame:
    rows, (pid, name), others = _fields(lines, 2)
    return rows.select(pid.cast("bigint").alias("part_id"), normalize_name(name).alias("part_name"), *others)


def parse_images(lines: DataFrame) -> DataFrame:
    rows, (iid, name), others = _fields(lines, 2)
    return rows.select(iid.cast("bigint").alias("image_id"), strip(name).alias("file_name"), *others)


def parse_boxes(lines: DataFrame) -> DataFrame:
    rows, (iid, *xywh), others = _fields(lines, 5, numbers=True)
    return rows.select(
        iid.cast("bigint").alias("image_id"),
        *[c.cast("double").alias(n) for n, c in zip(("box_x", "box_y", "box_w", "box_h"), xywh, strict=True)],
        *others,
    )


def parse_part_locs(lines: DataFrame) -> DataFrame:
    rows, (iid, pid, x, y, v), others = _fields(lines, 5, numbers=True)
    return rows.select(
        iid.cast("bigint").alias("image_id"),
        pid.cast("bigint").alias("part_id"),
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        v.cast("int").alias("v"),
        *others,
    )


def read_part_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The ``parts``, ``images``, ``boxes`` and ``locs`` tables below ``root``.

    Where a file names an id again, its last line counts; ``parts`` has ``part_order``, the rank
    of an id's first line. ``locs`` keeps all its lines with their ``place``: ``pivot_parts``
    takes the last line of a part itself, so the largest table is shuffled once.
    ``last_rows(locs, "image_id", "part_id")`` gives the table without repeated rows.
    """
    lines = {n: placed_lines(spark, f"{root.rstrip('/')}/{f}") for n, f in PART_FILES.items()}
    parts = parse_parts(lines["parts"])
    # The vocabulary of parts; a rank over it is a task of a few rows.
    rank = F.row_number().over(Window.orderBy("first")).cast("bigint")
    ordered = parts.groupBy("part_id").agg(
        F.max_by("part_name", "place").alias("part_name"), F.min("place").alias("first")
    )
    return {
        "parts": ordered.select("part_id", "part_name", rank.alias("part_order")),
        "images": last_rows(parse_images(lines["images"]), "image_id"),
        "boxes": last_rows(parse_boxes(lines["boxes"]), "image_id"),
        "locs": parse_part_locs(lines["locs"]),
    }


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``images`` and ``annotations`` of COCO documents.

    One JSON document is one task by nature of the format, so large sets should come as
    many documents (``path`` may name a folder) or as JSON-lines tables.
    """
    doc = spark.read.schema(COCO_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
    return {
        name: doc.select(F.explode(name).alias("row")).select("row.*")
        for name in ("images", "annotations")
    }


def read_coco_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The same two tables from JSON lines, one splittable folder per table."""
    schemas = {"images": COCO_IMAGE, "annotations": COCO_ANNOTATION}
    return {
        name: spark.read.schema(schema).json(f"{root.rstrip('/')}/{name}", mode="FAILFAST")
        for name, schema in schemas.items()
    }


def read_annotation_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``image_path, width, height, box, keypoints`` by header name.

    Absent columns and cells count as 0 dims and empty arrays; numbers that do not parse
    stop the job. ``multi_line`` allows line breaks in quoted cells, at the price of one
    task per file.
    """
    raw = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)

    def cell(name: str, default: str) -> Column:
        value = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default))

    def numbers(name: str) -> Column:
        return F.from_json(cell(name, "[]"), "array<double>", {"mode": "FAILFAST"})

    return raw.select(
        cell("image_path", "").alias("image_path"),
        cell("width", "0").cast("bigint").alias("width"),
        cell("height", "0").cast("bigint").alias("height"),
        numbers("bbox_json").alias("box"),
        numbers("keypoints_json").alias("keypoints"),
    )
