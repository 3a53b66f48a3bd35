"""Global positions without a one-task window.

``row_number`` without partition keys runs in one task, and with a hot key one group
does. Here the rows are range-partitioned on a unique order, so that a hot group spreads
over many tasks; only one count per partition is summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burstlens.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in its lower 33 bits


def _sorted_layout(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in a fixed range-partitioned order, with ``_part`` and ``_row``.

    The layout is checkpointed to the shared folder: counts and rows must see the same
    partitions, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    serial = F.monotonically_increasing_id()
    return placed.withColumn("_part", F.shiftright(serial, _ROW_BITS).cast("int")).withColumn(
        "_row", serial.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )


def _before(counts: DataFrame, *keys: str) -> Column:
    """Rows counted in earlier partitions (of the same keys)."""
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("_n").over(earlier), F.lit(0))


def dense_index(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Adds ``name`` = ``start, start+1, ...`` in the given unique order."""
    placed = _sorted_layout(df, order)
    # One row per partition: its size is bound by the partition count.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", _before(counts).alias("_offset"))
    joined = placed.join(F.broadcast(offsets), "_part")
    index = (F.col("_offset") + F.col("_row") + start).cast("bigint")
    return joined.select(*df.columns, index.alias(name))


def group_rank(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name`` = row number within ``group``; the order must be unique per group.

    After the range sort a group is a run of rows. All but the first partition of a run
    start with it, so at most one ``(group, partition)`` row per partition carries an
    offset, which bounds the broadcast by the partition count.
    """
    placed = _sorted_layout(df, [F.col(group), *order])
    runs = placed.groupBy(group, "_part").agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first")
    )
    # Runs that touch a partition border: the first or the last group of a partition.
    tail = runs.groupBy("_part").agg(F.max(F.struct("_first", group))[group].alias(group))
    head = runs.filter(F.col("_first") == 0)
    border = head.unionByName(runs.join(F.broadcast(tail), ["_part", group], "left_semi"))
    border = border.dropDuplicates(["_part", group])
    offsets = border.select(
        group, "_part", _before(border, group).cast("bigint").alias("_offset")
    ).filter(F.col("_offset") > 0)
    # Where a run has an offset it starts its partition, so its rows count from 0; other
    # runs count from the row where they start.
    first = Window.partitionBy("_part", group).orderBy("_row")
    local = placed.withColumn("_local", F.row_number().over(first))
    joined = local.join(F.broadcast(offsets), [group, "_part"], "left")
    rank = (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint")
    return joined.select(*df.columns, rank.alias(name))
