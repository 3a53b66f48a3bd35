"""Listing and reading of very many small files by tasks."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.session import scratch_path

_BATCH = 2000  # names or files that a task holds as a frame
_BATCH_BYTES = 8 << 20


def _uri(root: str) -> str:
    return root if ":/" in root else f"file://{root}"


def _files(root: str):
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(_uri(root))
    return files, base.rstrip("/")


def _hidden(name: str) -> bool:
    """Whether Spark's readers skip the name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def opens(root: str) -> bool:
    """Whether tasks can list ``root`` themselves, without Spark's readers."""
    from pyarrow import fs

    try:
        files, base = _files(root)
        return files.get_file_info(base).type == fs.FileType.Directory
    except (OSError, ValueError):  # pyarrow's own errors are of these kinds
        return False


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: ``path`` and ``length``, listed a folder a row, level by level.

    What is found is written to the shared folder, so no list passes through the driver. Names that
    begin with ``_`` or ``.`` are left out with all that is below them.
    """
    prefix = root.rstrip("/").removesuffix(_files(root)[1])

    def listed(batches):
        import pandas as pd
        from pyarrow import fs

        files, _ = _files(root)
        for batch in batches:
            for folder in batch["path"]:
                here = files.get_file_info(fs.FileSelector(folder.removeprefix(prefix)))
                shown = [i for i in here if not _hidden(i.base_name)]
                for at in range(0, len(shown), _BATCH):
                    part = shown[at : at + _BATCH]
                    yield pd.DataFrame(
                        {
                            "path": [prefix + i.path for i in part],
                            "length": [i.size or 0 for i in part],
                            "folder": [i.type == fs.FileType.Directory for i in part],
                        }
                    )

    folders = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    levels = []
    while True:
        path = scratch_path(spark, "listing")
        folders.mapInPandas(listed, "path string, length bigint, folder boolean").write.parquet(path)
        level = spark.read.schema("path string, length bigint, folder boolean").parquet(path)
        levels.append(level)
        below = level.filter("folder").select("path")
        if below.isEmpty():
            break
        folders = below.repartition(spark.sparkContext.defaultParallelism)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.filter("NOT folder").select("path", "length")


def read_texts(names: DataFrame, root: str, name: str = "file") -> DataFrame:
    """``name`` and ``value``, the whole text of each named file below ``root``.

    Tasks open the files of their names; neither names nor files pass through the driver.
    """

    def read(batches: Iterator):
        files, base = _files(root)
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.iloc[at : at + _BATCH]
                texts = []
                for file in part[name]:
                    with files.open_input_stream(f"{base}/{file}") as source:
                        texts.append(source.read().decode())
                yield part.assign(value=texts)

    return names.select(name).mapInPandas(read, f"{name} string, value string")


def read_packed(spark: SparkSession, root: str) -> DataFrame:
    """``file`` and ``value``, the whole text of each file in the packs below ``root``.

    See ``sinks.write_keyed_files``. Tasks list the packs and stream their members; a task holds the
    index of one pack, and the texts of _BATCH members or _BATCH_BYTES.
    """
    skip = len(root.rstrip("/").removesuffix(_files(root)[1]))

    def read(batches: Iterator):
        import pandas as pd

        files, _ = _files(root)
        for batch in batches:
            for path in batch["path"]:
                with files.open_input_file(path[skip:]) as source, zipfile.ZipFile(source) as pack:
                    names, texts, size = [], [], 0
                    for name in pack.namelist():
                        names.append(name)
                        texts.append(pack.read(name).decode())
                        size += len(texts[-1])
                        if len(names) >= _BATCH or size >= _BATCH_BYTES:
                            yield pd.DataFrame({"file": names, "value": texts})
                            names, texts, size = [], [], 0
                    if names:
                        yield pd.DataFrame({"file": names, "value": texts})

    packs = list_files(spark, root).filter(F.endswith("path", F.lit(".zip"))).select("path")
    spread = packs.repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInPandas(read, "file string, value string")
