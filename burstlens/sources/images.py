"""Image listing and image scan."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.constants import IMAGE_SUFFIXES
from burstlens.functions.names import suffix
from burstlens.session import scratch_path
from burstlens.sources.files import list_files, opens


def plain_path(uri: Column) -> Column:
    """File URI without its scheme decorations, so that both readers agree on a path."""
    return F.regexp_replace(uri, r"^file:/+", "/")


def plain_path_text(uri: str) -> str:
    """The same of one URI."""
    return re.sub(r"^file:/+", "/", uri)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files below ``root`` (``path``, ``length``), known by suffix; none is opened.

    Tasks list the folders, so the driver does not hold the files; see ``sources.files``. Where only
    Spark can open ``root``, its reader lists them in the driver.
    """
    if opens(root):
        files = list_files(spark, root)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(plain_path(F.col("path")).alias("path"), "length").filter(
        suffix(F.col("path")).isin(*IMAGE_SUFFIXES)
    )


def _suffix_glob() -> str:
    """File name pattern of all image suffixes, in any case."""
    names = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in IMAGE_SUFFIXES]
    return "*{" + ",".join(names) + "}"


# How files begin that a decoder of the JVM may take, with the usual plug-ins; others have no pixels.
_MARKS = (
    b"\xff", b"\x89PNG", b"GIF8", b"BM", b"\x00", b"II", b"MM", b"RIFF", b"8BPS", b"\x0a", b"\x01",
    b"v/1", b"icns", *(b"P%d" % n for n in range(1, 8)),
)
_FEW = 10_000  # files that the driver may hold by name
_HEAD = 54
_TASK_BYTES = 64 << 20  # of image files that a task decodes
_BATCH_BYTES = 8 << 20
_IMAGE = "struct<origin string, width int, height int, nChannels int, mode int, data binary>"


def _bitmap_dims(head: bytes, length: int) -> tuple[int, int] | None:
    """Width and height of a whole bitmap of 24 bits without compression, the plainest kind."""
    if len(head) < _HEAD or head[:2] != b"BM":
        return None
    offset, size, w, h, planes, bits, packing = struct.unpack("<IIiiHHI", head[10:34])
    if (offset, size, planes, bits, packing) != (_HEAD, 40, 1, 24, 0) or w < 1 or h < 1:
        return None
    return (w, h) if length >= _HEAD + (w * 3 + 3) // 4 * 4 * h else None


def _sort_files(spark: SparkSession, root: str) -> DataFrame:
    """Image files below ``root`` with their ``kind``, as a table in the shared folder.

    ``bitmap`` (decoded by tasks), ``none`` (begins like no image), ``other`` (all else, and names
    that an origin would escape). Tasks list the folders and read the files' first bytes.
    """
    base_root, marks, dims = root, _MARKS, _bitmap_dims

    def kinds(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(base_root if ":/" in base_root else f"file://{base_root}")
        skip = len(base_root.rstrip("/").removesuffix(base.rstrip("/")))
        for batch in batches:
            found = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                with files.open_input_stream(path[skip:], buffer_size=0) as source:
                    head = source.read(_HEAD)
                if not re.fullmatch(r"([a-z0-9]+:/+)?[A-Za-z0-9._/:-]*", path):
                    found.append("other")
                elif dims(head, length):
                    found.append("bitmap")
                else:
                    marked = head.startswith(marks) or head[4:8] == b"ftyp"
                    found.append("other" if marked else "none")
            yield batch.assign(kind=found)

    listed = list_files(spark, root).filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES))
    spread = listed.repartition(spark.sparkContext.defaultParallelism)
    kept = "path string, length bigint, kind string"
    table = scratch_path(spark, "image-files")
    spread.mapInPandas(kinds, kept).write.parquet(table)
    return spark.read.schema(kept).parquet(table)


def _decoder(root: str):
    """A function of ``uri`` and ``kind`` to what Spark's image source gives for the file.

    Null without a kind. A task holds the pixels of _BATCH_BYTES, or of one larger file.
    """
    base_root, dims, most, mode = root, _bitmap_dims, _BATCH_BYTES, 16  # as OpenCV names 3 x 8 bits

    def rows(uris, kinds):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(base_root if ":/" in base_root else f"file://{base_root}")
        skip = len(base_root.rstrip("/").removesuffix(base.rstrip("/")))
        for uri, kind in zip(uris.to_pylist(), kinds.to_pylist(), strict=True):
            if kind != "bitmap":
                yield None if kind is None else (uri, -1, -1, -1, -1, b"")
                continue
            with store.open_input_stream(uri[skip:], buffer_size=0) as source:
                body = source.read()
            w, h = dims(body[:_HEAD], len(body))
            step = (w * 3 + 3) // 4 * 4
            starts = range(_HEAD + step * (h - 1), _HEAD - 1, -step)  # lines run from the bottom up
            yield uri, w, h, 3, mode, b"".join(body[i : i + w * 3] for i in starts)

    @F.arrow_udf(_IMAGE)
    def image(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = ("origin", "width", "height", "nChannels", "mode", "data")
        kinds = (pa.string(), *[pa.int32()] * 4, pa.binary())

        def packed(some):
            columns = [pa.array(c, k) for c, k in zip(zip(*[r or (None,) * 6 for r in some], strict=True), kinds, strict=True)]
            return pa.StructArray.from_arrays(columns, names, mask=pa.array([r is None for r in some]))

        for uris, found in batches:
            held, size = [], 0
            for row in rows(uris, found):
                held.append(row)
                size += len(row[-1]) if row else 0
                if size >= most:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    # Not to be told twice: a filter on what is decoded would otherwise be pushed below, with a decoding of its own.
    return image.asNondeterministic()


def _source(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    reader = spark.read.format("image").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", _suffix_glob()).load(paths)


def image_files(
    spark: SparkSession, root: str, spread: bool = False
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Image files below ``root`` by ``path``, and what adds the columns of ``read_images`` to their rows.

    The rows may meet others before, so that no pixels move with them: tasks decode plain bitmaps only
    when the second part of the result is applied. Spark's image source, which lists files in the
    driver, gets the other files by name if they are few, and the whole folder if not (open: their
    listing); what it decodes is in the rows from the start. ``spread`` deals the files to tasks by
    their bytes, for rows that no join deals anew.
    """
    if not opens(root):
        return _early(_source(spark, root)), _columns
    files = _sort_files(spark, root)
    names = [r.path for r in files.filter("kind = 'other'").select("path").limit(_FEW + 1).collect()]
    if len(names) > _FEW or any(c in n for n in names for c in "*?[]{}\\,"):
        return _early(_source(spark, root)), _columns
    late = files.filter("kind <> 'other'").select(
        plain_path(F.col("path")).alias("path"), F.col("path").alias("_uri"), F.col("kind").alias("_kind")
    )
    if spread:
        size = files.agg(F.sum("length")).first()[0] or 0
        late = late.repartition(max(spark.sparkContext.defaultParallelism, size // _TASK_BYTES))
    decode = _decoder(root)("_uri", "_kind")
    if not names:
        return late, lambda rows: _columns(rows.withColumn("image", decode))
    listed = late.unionByName(_early(_source(spark, names)), allowMissingColumns=True)
    return listed, lambda rows: _columns(rows.withColumn("image", F.coalesce("image", decode)))


def _early(images: DataFrame) -> DataFrame:
    """What Spark's image source has decoded, by path."""
    fields = [F.col(f"image.{n}") for n in ("origin", "width", "height", "nChannels", "mode", "data")]
    return images.select(plain_path(F.col("image.origin")).alias("path"), F.struct(*fields).alias("image"))


def _columns(rows: DataFrame) -> DataFrame:
    """Rows with the column ``image`` taken apart."""
    return rows.withColumns(
        {
            "width": F.col("image.width"),
            "height": F.col("image.height"),
            "n_channels": F.col("image.nChannels"),
            "data": F.col("image.data"),
            "decoded": F.col("image.width") > 0,
        }
    ).drop("image", "_uri", "_kind")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images below ``root``: ``path, width, height, n_channels, data, decoded``.

    ``data`` is row-wise BGR (one channel for gray, four with alpha). A file that cannot
    be decoded stays in the table with ``decoded = false``; other files are not opened.
    """
    files, decode = image_files(spark, root, spread=True)
    return decode(files)
