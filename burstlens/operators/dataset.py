"""Training-set preparation: parts to keypoints, gates, split, label lines."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burstlens import constants as C
from burstlens.functions import landmarks as L
from burstlens.functions import names as N
from burstlens.operators.ordering import dense_index
from burstlens.schemas import PLACE

_PREFIX_HEX = 4  # 65,536 buckets of a uniform hash


_PLACE_BITS = 106  # a line's place needs no more, see sources.annotations.placed_lines


def pivot_parts(locs: DataFrame, parts: DataFrame) -> DataFrame:
    """Per image one nullable ``struct<x, y, v>`` per landmark part.

    Where several part ids share a name, the first one of ``part_order`` (else the lowest id)
    that the image has wins; where ``locs`` has a ``place``, the last row of a part. The part
    vocabulary goes to all tasks, by name of the side: Spark takes a table that grows out of a small
    file for small, and would send that one. Ranks and values are numbers of fixed size, so the
    aggregate hashes: the largest table is neither sorted nor shuffled before it is combined.
    """
    order = "part_order" if "part_order" in parts.columns else "part_id"
    wanted = parts.filter(F.col("part_name").isin(*C.LANDMARK_PARTS)).select(
        "part_id", "part_name", F.col(order).alias("_rank")
    )
    rank = F.col("_rank")
    if "place" in locs.columns and "bits" in locs.schema["place"].metadata:
        # Counted within a name, so that rank and place share a long.
        of_name = F.row_number().over(Window.partitionBy("part_name").orderBy("_rank", "part_id")) - 1
        many = F.raise_error(F.lit("more than 256 part ids share a name")).cast("int")
        wanted = wanted.withColumn("_rank", of_name).withColumn(
            "_rank", F.when(rank < 256, rank).otherwise(many).cast("bigint")
        )
        rank = rank * F.lit(1 << locs.schema["place"].metadata["bits"]) - F.col("place")
    elif "place" in locs.columns:
        above = rank.cast("decimal(6,0)") * F.lit(Decimal(1 << _PLACE_BITS))
        rank = (above - F.col("place")).cast(PLACE)
    named = locs.join(F.broadcast(wanted), "part_id").withColumn("_rank", rank)
    point = {"x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "v": F.col("v").cast("int")}
    found = []
    for name in C.LANDMARK_PARTS:
        of_name = F.when(F.col("part_name") == name, F.col("_rank"))
        found.append(F.count(of_name).alias(f"_{name}"))
        found += [F.min_by(c, of_name).alias(f"_{name}_{n}") for n, c in point.items()]
    flat = named.groupBy("image_id").agg(*found)
    marks = [
        F.when(F.col(f"_{n}") > 0, L.mark(*[F.col(f"_{n}_{c}") for c in point])).alias(n)
        for n in C.LANDMARK_PARTS
    ]
    return flat.select("image_id", *marks)


def part_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in C.LANDMARK_PARTS}


def box_column() -> Column:
    names = {"x": "box_x", "y": "box_y", "w": "box_w", "h": "box_h"}
    return F.struct(*[F.col(c).cast("double").alias(n) for n, c in names.items()])


def classify_images(
    images: DataFrame,
    boxes: DataFrame,
    files: DataFrame,
    pivoted: DataFrame,
    min_area_share: float = C.DEFAULT_GATES.box_area_share,
) -> DataFrame:
    """Adds ``outcome``: ``no_bbox`` (or no file), ``small``, ``no_eye_head``, ``kept``.

    ``files`` lists what exists, with pixel dims (``file_name, width, height``). Boxes and
    parts join on the image id, so one partitioning serves both. All four grow with the images,
    so none is sent whole to the tasks, however small its files are.
    """
    flat = images.withColumn("file_name", F.replace("file_name", F.lit("\\"), F.lit("/")))
    joined = (
        flat.join(files.hint("merge"), "file_name", "left")
        .join(boxes.hint("merge"), "image_id", "left")
        .join(pivoted.hint("merge"), "image_id", "left")
    )
    pixels = F.col("width").cast("double") * F.col("height")
    area = F.col("box_w") * F.col("box_h") / pixels
    outcome = (
        F.when(F.col("box_x").isNull() | F.col("width").isNull(), F.lit("no_bbox"))
        .when(area < min_area_share, F.lit("small"))
        .when(~L.has_eye_or_head(part_columns()), F.lit("no_eye_head"))
        .otherwise(F.lit("kept"))
    )
    return joined.withColumn("outcome", outcome)


def conversion_stats(classified: DataFrame) -> DataFrame:
    """One row: total and images per outcome."""
    return classified.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "no_bbox").alias("skipped_no_bbox"),
        F.count_if(F.col("outcome") == "small").alias("skipped_small_bbox"),
        F.count_if(F.col("outcome") == "no_eye_head").alias("skipped_no_eye_head"),
        F.count_if(F.col("outcome") == "kept").alias("kept"),
    )


def with_keypoints(pivoted: DataFrame) -> DataFrame:
    """Adds the flat ``keypoints`` vector and ``num_keypoints``; needs part and box columns."""
    marks = L.keypoint_marks(part_columns(), box_column())
    # Marks become columns before they are taken apart, so that each is computed once.
    named = pivoted.withColumns({f"_{name}": mark for name, mark in marks.items()})
    columns = {name: F.col(f"_{name}") for name in marks}
    flat = named.withColumn("keypoints", L.flatten_marks(columns)).drop(*[f"_{n}" for n in marks])
    return flat.withColumn("num_keypoints", L.num_keypoints(F.col("keypoints")))


def assign_ids(kept: DataFrame, order: str = "image_id", name: str = "id") -> DataFrame:
    """Dense annotation ids ``1..n`` by image id."""
    return dense_index(kept, [F.col(order)], name)


def number_kept(classified: DataFrame) -> DataFrame:
    """Kept images with keypoints and their annotation ``id``.

    The numbering writes its rows to the shared folder, so tables derived from this one
    do not repeat the classification.
    """
    kept = with_keypoints(classified.filter(F.col("outcome") == "kept"))
    return assign_ids(kept.select(*_KEPT_COLUMNS))


_KEPT_COLUMNS = (
    "image_id",
    "file_name",
    "width",
    "height",
    "box_x",
    "box_y",
    "box_w",
    "box_h",
    "keypoints",
    "num_keypoints",
)


def build_coco(numbered: DataFrame) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` tables of numbered images."""
    images = numbered.select(F.col("image_id").alias("id"), "file_name", "width", "height")
    annotations = numbered.select(
        "id",
        "image_id",
        F.lit(C.CATEGORY_ID).cast("bigint").alias("category_id"),
        F.array("box_x", "box_y", "box_w", "box_h").alias("bbox"),
        "keypoints",
        F.col("num_keypoints").cast("bigint").alias("num_keypoints"),
    )
    categories = numbered.sparkSession.createDataFrame(
        [(C.CATEGORY_ID, C.CATEGORY_NAME)], "id bigint, name string"
    )
    return {"images": images, "annotations": annotations, "categories": categories}


def existing_only(df: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    """Rows whose file is in the listing (unique ``path``)."""
    known = listing.select(F.col("path").alias(column))
    return df.join(known, column, "left_semi")


def join_annotations(
    images: DataFrame, annotations: DataFrame, columns: Sequence[str] = ("bbox", "keypoints")
) -> DataFrame:
    """One row per image and annotation, one with nulls for images without any.

    An image with very many annotations stays many rows, which adaptive skew join deals to
    several tasks; nothing is collected into a list. The join hashes the images, so annotations
    are not sorted, and only their ``columns`` travel.
    """
    anns = annotations.select("image_id", F.col("id").alias("ann_id"), *columns)
    meta = images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    matched = anns.join(meta.hint("shuffle_hash"), "image_id")
    annotated = anns.select("image_id").distinct()
    bare = meta.join(annotated, "image_id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def split_cut(groups: DataFrame, ratio: float, seed: int) -> Column:
    """The last ``(hash, group)`` that belongs to val, as one scalar subquery.

    Groups are put in order of ``md5(seed:group)`` and the first ``max(1, int(n * ratio))``
    are val. To find the last of them without sorting all groups, they are counted by hash
    prefix (at most 65,536 rows, one task), and only the groups of the one prefix that
    holds the boundary are ranked.
    """
    prefix = F.substring("h", 1, _PREFIX_HEX)
    hashed = groups.select("group", group_hash(F.col("group"), seed).alias("h"))
    counts = hashed.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) * F.lit(float(ratio))))
    placed = counts.select(
        "prefix", "n", F.sum("n").over(upto).alias("upto"), wanted.alias("wanted")
    )
    edge = placed.filter("upto - n < wanted AND wanted <= upto").select(
        "prefix", (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("nth")
    )
    inside = hashed.withColumn("prefix", prefix).join(F.broadcast(edge), "prefix")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("h", "group"))
    last = inside.withColumn("rank", rank).filter("rank = nth")
    return last.select(F.struct("h", "group").alias("cut")).scalar()


def group_hash(group: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), group))


def split_groups(
    df: DataFrame, column: str, ratio: float = C.VAL_RATIO, seed: int = C.SPLIT_SEED
) -> DataFrame:
    """Adds ``group`` (parent directory) and ``split``; no group is in both splits.

    Whether a row is val follows from its own group's hash and the boundary, so the split
    needs no join, however many rows one group has.
    """
    grouped = df.withColumn("group", N.group_key(F.col(column)))
    cut = split_cut(grouped.select("group").distinct(), ratio, seed)
    own = F.struct(group_hash(F.col("group"), seed).alias("h"), F.col("group").alias("group"))
    split = F.when(own <= cut, F.lit("val")).otherwise(F.lit("train"))
    return grouped.withColumn("split", split)


def _destinations(df: DataFrame, file_name: Column, label_name: Column) -> DataFrame:
    """Adds ``src``, ``dst`` and ``label``: what to copy where, and the label file."""
    return df.withColumns(
        {
            "dst": F.concat(F.lit("images/"), F.col("split"), F.lit("/"), file_name),
            "label": F.concat(F.lit("labels/"), F.col("split"), F.lit("/"), label_name),
        }
    )


def prepare_from_coco(
    images: DataFrame,
    annotations: DataFrame,
    listing: DataFrame,
    ratio: float = C.VAL_RATIO,
    seed: int = C.SPLIT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """``(manifest, labels)`` of a COCO set.

    ``manifest`` has one row per existing image (``image_id, src, dst, label, split``),
    ``labels`` one row per label line (``label, split, ann_id, line``). An image without
    usable annotations has a manifest row and no line, that is, an empty label file.
    """
    present = existing_only(images, listing, "file_name")
    placed = _destinations(
        split_groups(present, "file_name", ratio, seed),
        N.safe_name(F.col("file_name")),
        N.label_name(F.col("file_name")),
    )
    manifest = placed.select(
        F.col("id").alias("image_id"), F.col("file_name").alias("src"), "dst", "label", "split"
    )
    meta = placed.select(F.col("id").alias("image_id"), "width", "height", "label", "split")
    anns = annotations.select("image_id", F.col("id").alias("ann_id"), "bbox", "keypoints")
    lines = anns.join(meta, "image_id").filter(
        N.usable_label(F.col("bbox"), F.col("width"), F.col("height"))
    )
    return manifest, lines.select(
        "label",
        "split",
        "ann_id",
        N.label_line(F.col("bbox"), F.col("keypoints"), F.col("width"), F.col("height")).alias(
            "line"
        ),
    )


def prepare_from_csv(
    rows: DataFrame,
    listing: DataFrame,
    ratio: float = C.VAL_RATIO,
    seed: int = C.SPLIT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """``(manifest, labels)`` of an annotation CSV; missing dims come from the image.

    ``listing`` has the existing files with their dims (``path, width, height``). Files of
    one name in different folders share a destination, as they do in the flat layout this
    writes; ``collides`` marks them and no row is lost. A row without a whole box has a
    null ``line``.
    """
    split = split_groups(rows, "image_path", ratio, seed)
    dims = listing.select(
        F.col("path").alias("image_path"), F.col("width").alias("_w"), F.col("height").alias("_h")
    )
    found = split.join(dims, "image_path")
    unknown = (F.coalesce(F.col("width"), F.lit(0)) == 0) | (
        F.coalesce(F.col("height"), F.lit(0)) == 0
    )
    width = F.when(unknown, F.col("_w")).otherwise(F.col("width"))
    height = F.when(unknown, F.col("_h")).otherwise(F.col("height"))
    sized = found.withColumns({"width": width, "height": height}).drop("_w", "_h")
    name = N.base_name(F.col("image_path"))
    placed = _destinations(sized, name, F.concat(N.stem(name), F.lit(".txt")))
    box, kps = F.col("box"), F.col("keypoints")
    line = F.when(
        N.usable_label(box, F.col("width"), F.col("height")),
        N.label_line(box, kps, F.col("width"), F.col("height")),
    )
    labels = placed.select("image_path", "label", "split", line.alias("line"))
    manifest = placed.select(F.col("image_path").alias("src"), "dst", "label", "split")
    per_label = manifest.groupBy("label").agg(F.count("*").alias("_n")).filter("_n > 1")
    clash = per_label.select("label", F.lit(True).alias("_clash"))
    marked = manifest.join(clash, "label", "left").withColumn(
        "collides", F.coalesce(F.col("_clash"), F.lit(False))
    )
    return marked.drop("_clash"), labels


def convert_parts(
    tables: dict[str, DataFrame],
    files: DataFrame,
    ratio: float = C.VAL_RATIO,
    seed: int = C.SPLIT_SEED,
) -> dict[str, DataFrame]:
    """Part annotations to COCO tables, funnel counts, split manifest and label lines.

    A kept image has exactly one annotation, so its label line follows from its own row:
    after the numbering nothing is joined or shuffled again.
    """
    pivoted = pivot_parts(tables["locs"], tables["parts"])
    classified = classify_images(tables["images"], tables["boxes"], files, pivoted)
    numbered = number_kept(classified)
    placed = _destinations(
        split_groups(numbered, "file_name", ratio, seed),
        N.safe_name(F.col("file_name")),
        N.label_name(F.col("file_name")),
    )
    box = F.array("box_x", "box_y", "box_w", "box_h")
    line = N.label_line(box, F.col("keypoints"), F.col("width"), F.col("height"))
    return {
        "stats": conversion_stats(classified),
        **build_coco(numbered),
        "manifest": placed.select(
            "image_id", F.col("file_name").alias("src"), "dst", "label", "split"
        ),
        "labels": placed.select(
            "image_id", "label", "split", F.col("id").alias("ann_id"), line.alias("line")
        ),
    }
