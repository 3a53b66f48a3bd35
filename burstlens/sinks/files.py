"""One file per key, loose or in packs, as a data source that tasks write to and commit themselves."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING, DONE = "_staging", "_SUCCESS"
PACK_FILES, PACK_BYTES = 20_000, 64 << 20  # a pack is closed at either; its index is held by its reader


@dataclass
class Written(WriterCommitMessage):
    n_files: int
    n_pieces: int


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


class KeyedFiles(DataSource):
    """Rows of ``file`` and ``piece``: pieces of a file in the order of rows, null for none."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        packed = self.options.get("packed", "false").lower() == "true"
        return (PackedFilesWriter if packed else KeyedFilesWriter)(self.options)


class KeyedFilesWriter(DataSourceWriter):
    """A task writes its files to a folder of its own and moves them when all are whole.

    A lost task leaves only that folder. One that runs again, or twice, moves files of the same
    names and content, so readers never see part of a file. The driver gets two counts per task.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.separator = options.get("separator", "\n").encode()

    def _fill(self, out, rows: Iterator[Row]) -> int:
        """The pieces of one file into ``out``; returns their number."""
        n_pieces = 0
        for row in rows:
            if row[1] is None:
                continue
            if n_pieces:
                out.write(self.separator)
            out.write(row[1].encode() if isinstance(row[1], str) else bytes(row[1]))
            n_pieces += 1
        return n_pieces

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = _files(self.root)
        task = TaskContext.get()
        own = f"{base}/{STAGING}/{task.partitionId()}-{task.taskAttemptId()}"
        names, n_pieces = [], 0
        for name, rows in groupby(iterator, key=lambda row: row[0]):
            staged = f"{own}/{len(names)}"
            if not names:
                files.create_dir(own, recursive=True)
            with files.open_output_stream(staged) as out:
                n_pieces += self._fill(out, rows)
            names.append(name)
        made = set()
        for i, name in enumerate(names):
            folder = f"{base}/{name}".rsplit("/", 1)[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            files.move(f"{own}/{i}", f"{base}/{name}")
        return Written(len(names), n_pieces)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _files(self.root)
        self._drop_staging()
        n_files = sum(m.n_files for m in messages if m)
        with files.open_output_stream(f"{base}/{DONE}") as out:
            out.write(f"{n_files} files\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        from pyarrow import fs

        files, base = _files(self.root)
        files.create_dir(base, recursive=True)
        if files.get_file_info(f"{base}/{STAGING}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{STAGING}")


class PackedFilesWriter(KeyedFilesWriter):
    """The same files as members of zip archives, some thousands in each, below a new folder.

    A small file of its own takes a block and an inode of the disk, many times its bytes. Packs are
    named after this write, the task's partition and their number, so one that runs again replaces its own.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        files, base = _files(self.root)
        if files.get_file_info(f"{base}/{DONE}").is_file:
            raise ValueError(f"packs need a new folder, {self.root} holds files of an earlier write")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = _files(self.root)
        task = TaskContext.get()
        own = f"{base}/{STAGING}/{task.partitionId()}-{task.taskAttemptId()}"
        n_packs = n_files = n_pieces = 0
        with ExitStack() as opened:
            pack = sink = None
            for name, rows in groupby(iterator, key=lambda row: row[0]):
                if pack is not None and (len(pack.filelist) >= PACK_FILES or sink.tell() >= PACK_BYTES):
                    opened.close()
                    pack = None
                if pack is None:
                    if not n_packs:
                        files.create_dir(own, recursive=True)
                    sink = opened.enter_context(files.open_output_stream(f"{own}/{n_packs}"))
                    pack = opened.enter_context(zipfile.ZipFile(sink, "w"))
                    n_packs += 1
                member = zipfile.ZipInfo(name)  # its fixed date makes a second run's packs the same
                member.compress_type = zipfile.ZIP_DEFLATED
                with pack.open(member, "w", force_zip64=True) as out:
                    n_pieces += self._fill(out, rows)
                n_files += 1
        for i in range(n_packs):
            files.move(f"{own}/{i}", f"{base}/{self.run}-{task.partitionId()}-{i}.zip")
        return Written(n_files, n_pieces)


def write_keyed_files(
    pieces: DataFrame,
    root: str,
    order: list[str] | None = None,
    separator: str = "\n",
    packed: bool = False,
) -> None:
    """``file`` and ``piece`` rows to one file per ``file`` below ``root``.

    Pieces of a file follow ``order``. A file is streamed by one task, whatever its size; what
    travels is each row once. Files that exist are replaced, others are left alone. With ``packed``
    the files are members of zip archives in the new folder ``root``; see ``sources.files.read_packed``.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(KeyedFiles)
    placed = pieces.repartition("file").sortWithinPartitions("file", *(order or []))
    rows = placed.select("file", "piece")
    writer = rows.write.format("keyed_files").option("separator", separator).option("packed", packed)
    writer.mode("append").save(root)


def write_label_files(
    manifest: DataFrame, labels: DataFrame, root: str, order: str = "ann_id", packed: bool = False
) -> None:
    """The label files of a manifest under the names it gives, an empty one for no line.

    A label is some 200 bytes and a loose file a block of the disk, 4 KB as a rule; ``packed`` files
    have the same names and bytes in archives.
    """
    names = manifest.select(F.col("label").alias("file")).distinct()
    lines = labels.filter(F.col("line").isNotNull()).select(
        F.col("label").alias("file"),
        F.concat("line", F.lit("\n")).alias("piece"),
        F.col(order).alias("_order"),
    )
    write_keyed_files(names.join(lines, "file", "left"), root, ["_order"], separator="", packed=packed)


def write_crop_files(crops: DataFrame, root: str) -> None:
    """Gray crops (``crop_path``, dims, ``gray``) as portable graymaps under their tags."""
    size = F.concat_ws(" ", "crop_width_px", "crop_height_px")
    head = F.concat(F.lit("P5\n"), size, F.lit("\n255\n")).cast("binary")
    name = F.regexp_replace("crop_path", r"\.[^./]+$", ".pgm")
    shown = crops.filter((F.col("crop_width_px") > 0) & F.col("crop_path").isNotNull())
    write_keyed_files(shown.select(name.alias("file"), F.concat(head, "gray").alias("piece")), root)
