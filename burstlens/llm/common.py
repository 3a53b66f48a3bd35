"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.session import scratch_path

# Text that one numpy pass handles at a time; only memory depends on it, not results.
PASS_BYTES = 2_000_000
# Bytes that are neither a space nor one of \t \n \v \f \r; bytes.split() splits there too.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow type of a key column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_texts(
    docs: DataFrame,
    key: str,
    text: str,
    fields: list[T.StructField],
    work: Callable[[list], list[Iterable]],
) -> DataFrame:
    """One row per document: the key and what ``work`` makes of a list of texts.

    ``work`` gets the texts of one Arrow batch (null stays None) and gives one sequence per
    field. Batches are cut so that one pass holds about PASS_BYTES, or one long text.
    """
    schema = T.StructType([docs.schema[key], *fields])
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in cuts(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                columns = work(part.column(1).to_pylist())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def cuts(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values (the finaliser of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1) from mixed 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read again, so that no step computes it twice.

    Shuffle files of a finished step are never read again, so Spark may drop them at once.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sizes the number of buckets, never what goes in."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
