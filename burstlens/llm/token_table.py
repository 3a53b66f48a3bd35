"""Token ids as Parquet tables that can be read in part.

A table is a folder with ``tokens`` and ``shards``. ``tokens`` has one file for each shard, in
ascending order of documents; a row is a document, or a part of at most PART_IDS ids of a long
one, so pages and row groups stay small whatever a document's length. Ids are dictionary or
delta encoded, keys and offsets delta encoded, row groups have a set size, and page indexes
let a reader skip pages. ``offset`` counts ids within the shard; ``shards`` has one row for each
shard with the ids of all shards before it, so ids are written once, while totals are unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm.common import arrow_type, cuts, text_bytes
from burstlens.llm.token_memo import Memo, byte_level

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
PART_IDS = 65_536
SHARD_BYTES = 128 << 20  # of text
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PASS_BYTES = 8_000_000
IDS = "ids.list.element"  # the column of ids in a file


def writer_options(
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> dict[str, str]:
    """Options of Spark's Parquet writer; its second version delta encodes what has no dictionary."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    return {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false",
        f"parquet.enable.dictionary#{IDS}": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": "4096",
        "parquet.page.size.row.check.min": "8",  # rows may be large, so sizes are looked at early
    }


def write_token_table(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    shards: int | None = None,
    make_memo: Callable[[str], Memo] = byte_level,
    **layout,
) -> None:
    """Encodes whole texts, adds ``end_id`` to each, and writes them in ascending order of ``key``.

    Null and empty texts are ``end_id`` alone. Null keys come last; rows with equal keys stand
    in the order of their text's hash, equal rows one after the other, and may lie in several
    shards. An empty table gives an empty one. Other columns are not looked at. Texts move once,
    to their place in the order, and are encoded there.
    """
    spark = docs.sparkSession
    if shards is None:
        shards = max(
            2 * spark.sparkContext.defaultParallelism, -(-text_bytes(docs, text) // SHARD_BYTES)
        )
    kind = T.StructField("key", docs.schema[key].dataType)
    order = [F.col("key").asc_nulls_last(), "spread", "nth"]
    placed = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .withColumn("spread", F.xxhash64("text"))
        .withColumn("nth", F.monotonically_increasing_id())
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select("key", "text")
    )
    schema = T.StructType(
        [
            kind,
            T.StructField("shard", T.IntegerType(), False),
            T.StructField("offset", T.LongType(), False),
            T.StructField("part", T.IntegerType(), False),
            T.StructField("n_ids", T.IntegerType(), False),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
        ]
    )
    key_kind = arrow_type(kind.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = make_memo(vocabulary)
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in cuts(batch.column(1), PASS_BYTES):
                rows = batch.slice(lo, hi - lo)
                ids, counts = memo.encode(rows.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                starts = np.cumsum(counts) - counts
                parts = -(-counts // PART_IDS)
                row = np.repeat(np.arange(len(counts)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = starts[row] + part * PART_IDS
                size = np.minimum(PART_IDS, starts[row] + counts[row] - begin)
                offsets = np.append(begin, len(ids)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(row)).cast(key_kind),
                        pa.array(np.full(len(row), shard, np.int32)),
                        pa.array(before + starts[row]),
                        pa.array(part.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                    ],
                    names=schema.names,
                )
                before += int(counts.sum())

    encoded = placed.mapInArrow(run, schema).withColumnRenamed("key", key)
    encoded.write.options(**writer_options(**layout)).parquet(f"{path}/tokens")
    written = spark.read.schema(encoded.schema).parquet(f"{path}/tokens")
    totals = written.groupBy("shard").agg(
        F.sum("n_ids").alias("n_ids"),
        F.count_if(F.col("part") == 0).alias("n_docs"),
        F.min(key).alias("first_key"),
        F.max(key).alias("last_key"),
    )
    # One row for each shard, so for each 128 MB of text.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    totals.withColumn("base", base).coalesce(1).write.parquet(f"{path}/shards")


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``tokens`` with ``start``, the place of a row's first id among all ids.

    Columns that are not asked for are not read: without ``ids`` this reads keys and offsets.
    Filters on the key or on ``offset`` and ``shard`` skip row groups and pages.
    """
    tokens = spark.read.parquet(f"{path}/tokens")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "base")
    return tokens.join(F.broadcast(shards), "shard").withColumn(
        "start", F.col("base") + F.col("offset") + F.col("part").cast("long") * PART_IDS
    )


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``start`` and ``ids`` of the rows that hold ids ``start`` to ``stop``, cut to them.

    The shards that hold the span are looked up first, so only their row groups are read.
    """
    shards = spark.read.parquet(f"{path}/shards")
    held = shards.filter((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start))
    some = [r[0] for r in held.select("shard").collect()]  # as many as the span has shards
    rows = read_token_table(spark, path).filter(F.col("shard").isin(some))
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    last = F.least(F.lit(stop) - F.col("start"), F.col("n_ids"))
    inside = (F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)
    return rows.filter(inside).select(
        (F.col("start") + first).alias("start"),
        F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"),
    )


def _times_x(value: int, by: int) -> int:
    """Product of two residues of the CRC-32 polynomial, bits reversed as in zlib."""
    out = 0
    while by:
        if by & 0x80000000:
            out ^= value
        by = (by << 1) & 0xFFFFFFFF
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return out


def crc_join(crc: int, other: int, size: int) -> int:
    """CRC-32 of two byte strings in a row from theirs and the second's size."""
    power, square = 0x80000000, 0x00800000  # 1 and x to the 8, for one byte
    while size:
        if size & 1:
            power = _times_x(power, square)
        square = _times_x(square, square)
        size >>= 1
    return _times_x(crc, power) ^ other


def token_digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, read from a table.

    Ids stay where they are read; what meets for a document is one checksum for each part.
    """
    rows = read_token_table(spark, path)
    kind = rows.schema[key].dataType
    names = [key, "shard", "offset", "part", "start", "n_ids"]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("crc", T.LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = np.cumsum(batch.column(5).to_numpy()) * 4
            lo, out = 0, []
            for hi in ends.tolist():
                out.append(zlib.crc32(raw[lo:hi]))
                lo = hi
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.int64())], names=schema.names
            )

    # A document in one row needs no shuffle; row groups without long ones are skipped for them.
    whole = "part = 0 and n_ids < %d" % PART_IDS
    first, long = (
        rows.filter(some).select(*names, "ids").mapInArrow(check, schema)
        for some in (whole, f"not ({whole})")
    )
    part = F.struct("part", "n_ids", "crc", "start")
    folded = long.groupBy("shard", "offset").agg(
        F.first(key).alias(key), F.array_sort(F.collect_list(part)).alias("parts")
    )
    out = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column(1).to_pylist():
                crc = 0
                for p in parts:
                    crc = crc_join(crc, p["crc"], 4 * p["n_ids"])
                found.append((parts[0]["start"], sum(p["n_ids"] for p in parts), crc))
            columns = zip(*found, strict=True) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=out.names
            )

    short = first.select(
        key, "start", _long("n_ids").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )
    return short.unionByName(folded.select(key, "parts").mapInArrow(fold, out))


def _long(name: str) -> Column:
    return F.col(name).cast("long")
