"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is reached by giving each of its documents ``target / size`` copies. The
whole part is certain; the fractional parts are rounded in pairs: words of expected mass move
from one document to the other, by a fair lottery, until one of the two is integral. The
expected copies of each document stay as they were and a source's words stay at its target,
up to the last document that no partner is left for, which is a small one.

Documents are dealt to groups by hash, each group rounds its own and keeps at most one open
document per source; open documents meet in the next, smaller set of groups, until one group
per source is left. A source of any size is therefore never in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlens.llm.common import WORD_PATTERN, mix64, stored, uniform
from burstlens.operators.ordering import dense_index

GROUP_ROWS = 1_024  # documents that meet in one group of the tree
TIERS = (1_024, 256, 64, 16, 0)  # words from which on a document is of a tier, large ones first
HOT_SOURCES = 1_000  # so many sources at most are sent to all tasks
MAX_COPIES = 3  # a target is at most so many times its source


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(rows: DataFrame, weights: tuple = (1, 2, 3)) -> DataFrame:
    """One row per source of ``rows`` (``source``, ``size``): count, size and target.

    With caps, the targets are ``min(cap, level * weight)`` for the one level at which they sum
    up to all sizes. It rises from the level without caps: each turn caps the sources that have
    reached theirs and shares what they leave, until no other source does. Sources are
    numbered by a range sort, and a turn is one sum over them.
    """
    totals = rows.groupBy("source").agg(
        F.count("*").alias("source_rows"), F.sum("size").cast("bigint").alias("source_size")
    )
    placed = dense_index(totals, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))
    weighed = stored(
        placed.withColumn("weight", weight).withColumn("cap", F.lit(MAX_COPIES) * F.col("source_size")),
        "sources",
    )
    level = 0.0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        fact = weighed.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0))).alias("left"),
            F.sum(F.when(~capped, F.col("weight"))).alias("rest"),
        ).first()
        if not fact["rest"] or not fact["left"] / fact["rest"] > level:
            break
        level = fact["left"] / fact["rest"]
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_rows", "source_size", target.alias("target"))


def _with_shares(rows: DataFrame, shares: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` with the columns of ``shares``, whose key is ``_s``.

    The sources with at least ``hot_rows`` rows, ``HOT_SOURCES`` at most, go to all tasks, so
    that their rows stay where they are. Rows of the others meet their source by hash.
    """
    same = F.expr("source <=> _s")
    hot = F.broadcast(shares.filter(F.col("source_rows") >= hot_rows))
    cold = shares.filter(F.col("source_rows") < hot_rows)
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(cold, same))


def _round_group(seed: int):
    """Rounds the fractional parts of one group; at most one row stays open."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that the one that stays open is small.
        order = ["size", "_order", "_nth"]
        rows = rows.sort_values(order, ascending=[False, True, True]).reset_index(drop=True)
        part, size = rows["_part"].to_numpy().copy(), rows["size"].to_numpy(np.float64)
        draw = rows["_order"].to_numpy(np.int64).view(np.uint64) + rows["_nth"].to_numpy(
            np.int64
        ).view(np.uint64)
        luck = uniform(mix64(mix64(draw) ^ np.uint64(seed)))
        held = -1
        for i in range(len(rows)):
            if not 0.0 < part[i] < 1.0:
                continue
            if held < 0:
                held = i
                continue
            # Expected words that can move to the held document or from it.
            gain = min((1 - part[held]) * size[held], part[i] * size[i])
            loss = min(part[held] * size[held], (1 - part[i]) * size[i])
            move = gain if luck[i] * (gain + loss) < loss else -loss
            for k, words in ((held, move), (i, -move)):
                part[k] += words / size[k]
                if min(part[k], 1 - part[k]) * size[k] < 1e-6:
                    part[k] = float(round(part[k]))
            held = next((k for k in (held, i) if 0.0 < part[k] < 1.0), -1)
        rows["_part"] = part
        return rows

    return run


def _round_tier(placed: DataFrame, most: int, seed: int, group_rows: int) -> DataFrame:
    """``placed`` with ``copies``: a tree of groups, then a lottery for what no partner is left for.

    Each level is one shuffle of slim rows to groups of about ``group_rows``; decided rows
    leave, open ones (one per group at most) go up.
    """
    groups = F.ceil(F.col("source_rows") / F.lit(group_rows))
    level, decided = 0, []
    while most > 1:
        bucket = F.pmod(F.xxhash64(F.lit(level), "_order", "_nth"), groups)
        rounded = stored(
            placed.withColumn("_bucket", bucket)
            .groupBy("source", "_bucket")
            .applyInPandas(_round_group(seed + level), _with(placed, "_bucket bigint"))
            .drop("_bucket")
        )
        is_open = (F.col("_part") > 0) & (F.col("_part") < 1)
        decided.append(rounded.filter(~is_open))
        placed = rounded.filter(is_open)
        most = math.ceil(most / group_rows)
        groups = F.ceil(groups / F.lit(group_rows))
        level += 1
    luck = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "_order", "_nth"), F.lit(1 << 53))
    last = placed.withColumn(
        "_part", (luck / F.lit(float(1 << 53)) < F.col("_part")).cast("double")
    )
    for part in decided:
        last = last.unionByName(part)
    return last.withColumn("copies", (F.col("_whole") + F.round("_part")).cast("bigint"))


def copy_counts(
    rows: DataFrame,
    weights: tuple = (1, 2, 3),
    seed: int = 0,
    group_rows: int = GROUP_ROWS,
    tiers: tuple = TIERS,
) -> DataFrame:
    """``rows`` (``source``, ``size``, ``_order``, ``_nth`` and others) with the number of copies.

    The last document of a tree is rounded without a partner; it may be any of its tier. Large
    documents therefore come first, and the words by which they miss their share are spread
    evenly over the smaller ones. The smallest tier that a source has leaves an error of one of
    its documents, more only where shares of none or of ``MAX_COPIES`` stop the spreading.
    """
    rows = stored(rows)
    state = stored(source_targets(rows, weights).withColumn("carry", F.lit(0.0)))
    fact = state.agg(F.max("source_rows").alias("most"), F.sum("source_rows").alias("all")).first()
    most, hot_rows = fact["most"] or 0, math.ceil((fact["all"] or 0) / HOT_SOURCES)
    ratio = F.coalesce(
        F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)
    )
    done, upper = [], None
    for tier, lower in enumerate(tiers):
        here = F.col("size") >= lower
        if upper is not None:
            here &= F.col("size") < upper
        upper = lower
        mine = rows.filter(here)
        held = mine.groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("_held"))
        now = state.join(held, F.expr("source <=> _s"), "left").drop("_s")
        spread = F.coalesce(F.col("carry") / F.when(F.col("_held") > 0, F.col("_held")), F.lit(0.0))
        share = F.least(F.greatest(ratio + spread, F.lit(0.0)), F.lit(float(MAX_COPIES)))
        shares = now.select(
            F.col("source").alias("_s"), "source_rows", "source_size", "target",
            share.alias("_share"),
        )
        placed = _with_shares(mine, shares, hot_rows).select(
            *rows.columns, "source_rows", "source_size", "target",
            F.when(F.col("size") > 0, F.floor("_share")).otherwise(0).cast("bigint").alias("_whole"),
            F.when(F.col("size") > 0, F.col("_share") - F.floor("_share")).otherwise(0.0).alias("_part"),
        )
        rounded = _round_tier(placed, most, seed + 100 * tier, group_rows)
        done.append(rounded.drop("_whole", "_part", "source_rows"))
        if tier + 1 < len(tiers):
            taken = rounded.groupBy(F.col("source").alias("_s")).agg(
                F.sum(F.col("size") * F.col("copies")).alias("_taken")
            )
            missed = ratio * F.coalesce("_held", F.lit(0)) - F.coalesce("_taken", F.lit(0))
            state = stored(
                now.join(taken, F.expr("source <=> _s"), "left").select(
                    "source", "source_rows", "source_size", "target",
                    (F.col("carry") + missed).alias("carry"),
                )
            )
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def mixed_sizes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = (1, 2, 3),
    seed: int = 0,
) -> DataFrame:
    """``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` of every row.

    Null texts have size 0 and no copy, nor have texts without words. A null source is a source
    of its own and comes last. Repeated rows are counted and rounded one by one. Other columns
    are not looked at. The result depends on rows and seed alone, not on how rows are dealt.
    An empty table gives no rows.
    """
    return copy_counts(_slim(docs, key, text, source, seed), weights, seed)


def _slim(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))
    rows = docs.select(
        F.col(key), F.col(source).alias("source"), word_count(text).alias("size"),
        order.alias("_order"),
    )
    return rows.withColumn("_nth", _nth("_order", "source"))


def _nth(*columns: str) -> Column:
    """Number among rows that are equal in all that counts; they may be swapped freely."""
    return F.row_number().over(Window.partitionBy(*columns).orderBy(columns[0])).cast("bigint")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = (1, 2, 3),
    seed: int = 0,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    Rows without words are never taken; a null source is a source of its own; equal rows are
    taken one by one and may be swapped. No name of the columns can clash.
    """
    copies = mixed_sizes(docs, key, text, source, weights, seed).select(
        F.col("_order").alias("_copy_order"), F.col("source").alias("_copy_source"),
        F.col("_nth").alias("_copy_nth"), "copies",
    )
    # The caller's row travels as one value.
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).alias("_order"),
        F.col(f"`{source}`").alias("_source"),
    ).withColumn("_nth", _nth("_order", "_source"))
    both = named.join(
        copies.filter("copies > 0"),
        F.expr("_order = _copy_order AND _nth = _copy_nth AND _source <=> _copy_source"),
    )
    again = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return both.select("given", F.explode(again)).select("given.*")
