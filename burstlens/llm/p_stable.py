"""Approximate neighbours by multiprobe p-stable hashing.

A table hashes a vector to ``floor((a x + b) / w)`` for a few Gaussian (2-stable) directions
``a``. A neighbour at distance r lies normally distributed around the query along each
direction, so each perturbed bucket has a success probability; a query visits the buckets of
each table in falling order of it. Candidates of all tables are merged and ranked by their
exact distance. The tenth found bounds the distance of the true tenth: queries for which it is
farther than their probes were chosen for probe again for that distance, and those that found
fewer, or cannot reach the success, are compared with all rows in blocks.

Equal vectors are one candidate with its smallest ids, and equal queries are searched once, so
a vector that a third of all rows share costs no more than any other. Rows meet queries by
bucket; buckets with more than ``HOT`` rows are dealt to several tasks. Only the best few
candidates leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstlens.llm.common import mix64, stored

HOT = 4_096  # rows of a bucket that one task compares with the queries at once
ASKED = 512  # queries that are compared with the rows of a batch at once
SAMPLE = 200  # vectors whose neighbours among all rows give the width of the buckets
FAR = 0.9  # share of the sample whose last neighbour the first probes reach out for
_ERF = np.frompyfunc(erf, 1, 1)


@dataclass(frozen=True)
class Tables:
    """Directions and offsets of all tables: ``tables`` x ``depth`` hashes of ``dim`` numbers."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    radius: float

    @classmethod
    def fit(cls, reach: np.ndarray, dim: int, n_rows: int, tables: int, seed: int) -> Tables:
        """Width and radius from sampled distances ``reach``, depth from the number of rows."""
        draw = np.random.default_rng(seed)
        reach = reach[np.isfinite(reach) & (reach > 0)]
        middle, radius = np.quantile(reach, [0.5, FAR]) if len(reach) else (1.0, 1.0)
        depth = max(2, round(0.75 * log2(max(n_rows, 128) / 16)))
        return cls(
            draw.standard_normal((tables, depth, dim)),
            draw.uniform(0, 1, (tables, depth)),
            2.0 * float(middle),
            float(radius),
        )

    def project(self, x: np.ndarray) -> np.ndarray:
        """Projections in bucket widths: rows x tables x depth."""
        flat = self.directions.reshape(-1, self.directions.shape[2])
        value = (x @ flat.T).reshape(len(x), *self.offsets.shape)
        return value / self.width + self.offsets

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row of slot numbers; tables are told apart."""
        n_tables, depth = self.offsets.shape
        with np.errstate(over="ignore"):
            key = mix64(np.arange(1, n_tables + 1, dtype=np.uint64))
            key = np.broadcast_to(
                key.reshape(-1, *([1] * (slots.ndim - 3))), slots.shape[:-1]
            ).copy()
            for i in range(depth):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + slots[..., i].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def probes(self, x: np.ndarray, radius: np.ndarray, success: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the most promising buckets of each table, rows x tables x probes, which count,
        and the rows for which they reach ``success`` for a neighbour at their ``radius``.

        Buckets are visited until the estimate that one of all tables holds a neighbour
        reaches ``success``. Directions are taken one after the other; the best partial
        perturbations of the first ones are all that the best perturbations of all can begin
        with. Longer keys get longer lists, of at most a quarter of their 2^depth home cells.
        """
        n_tables, depth = self.offsets.shape
        most = max(32, 1 << (depth - 2))
        enough = 1 - (1 - success) ** (1 / n_tables)
        place = self.project(x)
        home = np.floor(place)
        inside = (place - home)[..., None]
        edges = (np.arange(-1, 3) - inside) * self.width / radius[:, None, None, None]
        below = 0.5 * (1 + _ERF(edges / sqrt(2)).astype(float))
        cost = -np.log(np.maximum(np.diff(below, axis=-1), 1e-12))  # slots -1, 0, +1
        total = np.zeros((*home.shape[:2], 1))
        moves = np.zeros((*home.shape[:2], 1, 0), np.int8)
        step = np.array([-1, 0, 1], np.int8)
        for i in range(home.shape[2]):
            wide = (total[..., None] + cost[:, :, i][:, :, None, :]).reshape(*home.shape[:2], -1)
            order = np.argsort(wide, axis=-1, kind="stable")[..., :most]
            total = np.take_along_axis(wide, order, -1)
            moves = np.concatenate(
                [np.take_along_axis(moves, (order // 3)[..., None], 2), step[order % 3][..., None]], -1
            )
        chance = np.exp(-total)
        visited = np.cumsum(chance, -1) - chance < enough
        missed = np.prod(1 - np.minimum((chance * visited).sum(-1), 1), -1)
        return self.keys(home[:, :, None, :] + moves), visited, missed <= 1 - success + 1e-9


def _reach(sample: np.ndarray, n: int):
    """The ``n`` smallest distances of each sampled vector among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(sample), n), np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, HOT):
                x = _matrix(batch.slice(lo, HOT).column(0))
                square = (sample**2).sum(1)[:, None] + (x**2).sum(1) - 2 * sample @ x.T
                both = np.concatenate([best, np.sqrt(np.maximum(square, 0))], axis=1)
                best = np.partition(both, n - 1, axis=1)[:, :n]
        of, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(of.astype(np.int32)), pa.array(best[np.isfinite(best)])], names=["of", "score"]
        )

    return run


def _index(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            keys = tables.keys(np.floor(tables.project(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _nested(keys)], names=["id", "vec", "keys"]
            )

    return run


def _probe(tables: Tables, success: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                radius = part.column(2).to_numpy(zero_copy_only=False)
                keys, visited, reached = tables.probes(_matrix(part.column(1)), radius, success)
                offsets = np.concatenate([[0], np.cumsum(visited.sum((1, 2)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[visited]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists, pa.array(reached)],
                    names=["id", "vec", "keys", "reached"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nested(keys: np.ndarray) -> pa.Array:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, top: int) -> tuple:
    """The ``top`` nearest different candidates of each query."""
    order = np.lexsort((found, score, query))
    query, found, score = query[order], found[order], score[order]
    twin = np.concatenate(
        [[False], (query[1:] == query[:-1]) & (found[1:] == found[:-1])]
    )
    query, found, score = query[~twin], found[~twin], score[~twin]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else []
    nth = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
    keep = nth < top
    return query[keep], found[keep], score[keep]


def _compare(top: int):
    """Nearest candidates of the queries, from rows sorted by bucket with its queries first."""
    names = ["query", "found", "score"]

    def pairs(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # The rough distance is off by rounding alone: whatever may be among the nearest
        # within that bound, equally near rows included, is measured exactly.
        square = (x**2).sum(1)
        rough = square - 2 * q @ x.T
        nth = min(top, len(x)) - 1
        longest = np.sqrt(square.max()) + np.sqrt((q**2).sum(1))
        slack = 4 * (x.shape[1] + 2) * np.finfo(np.float64).eps * longest**2
        limit = np.partition(rough, nth, axis=1)[:, nth] + slack
        asking, near = np.nonzero(~(rough > limit[:, None]))  # where sums overflow, all stay
        score = np.empty(len(near))
        step = max(1, 2_000_000 // x.shape[1])
        for lo in range(0, len(near), step):
            at = slice(lo, lo + step)
            score[at] = np.sqrt(((x[near[at]] - q[asking[at]]) ** 2).sum(1))
        return asking, near, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        current, asked = None, []

        def flush() -> pa.RecordBatch:
            arrays = [np.concatenate(c) for c in zip(*held, strict=True)]
            best = _best(*arrays, top)
            held[:] = [best]
            return pa.RecordBatch.from_arrays([pa.array(b) for b in best], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, salt, is_row, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            x = _matrix(batch.column(4))
            change = (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])
            for lo, hi in zip(
                *(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(change) + 1, [len(ids)]])),
                strict=True,
            ):
                if (bucket[lo], salt[lo]) != current:
                    current, asked = (bucket[lo], salt[lo]), []
                split = lo + int(np.searchsorted(is_row[lo:hi], 1))
                if split > lo:
                    asked.append((ids[lo:split], x[lo:split]))
                if split < hi:
                    for query, q in asked:
                        for at in range(0, len(q), ASKED):
                            asking, near, score = pairs(q[at : at + ASKED], x[split:hi])
                            best = _best(query[at : at + ASKED][asking], ids[split:hi][near], score, top)
                            held.append(best)
                            size += len(best[2])
                if size > 500_000:
                    best = flush()
                    size = len(best)
                    if size > 250_000:  # very many queries: what is known so far goes on
                        yield best
                        held, size = [], 0
        if held:
            yield flush()

    return run


def nearest(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    top: int = 10,
    tables: int = 12,
    success: float = 0.94,
    seed: int = 0,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest rows of each query.

    Queries are the rows whose key is divisible by ``every``; a row is no candidate of its own.
    Scores are Euclidean distances in double precision; ties go to the smaller key. Null, zero
    and non-finite vectors and null keys take no part, nor do vectors with another number of
    components than most have; repeated keys count once for each different vector. Tables
    that are empty, or have no query, give no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("vec")
    ).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)) & F.exists("vec", lambda v: v != 0))
    fact = rows.agg(F.mode(F.size("vec")).alias("dim"), F.count("*").alias("n")).first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not fact["n"]:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("vec") == fact["dim"])
    # The smallest ids of equal vectors are all that any query can get of them.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    classes = (
        rows.dropDuplicates(["id", "vec"])
        .withColumn("place", place)
        .filter(F.col("place") <= top + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("id", F.get("ids", F.lit(0)))
    )
    classes = stored(classes, "vectors")
    order = F.xxhash64("id")
    sample = np.array([r[0] for r in classes.orderBy(order, "id").select("vec").limit(SAMPLE).collect()], np.float64)
    # A vector is its own nearest.
    nth = F.row_number().over(Window.partitionBy("of").orderBy("score"))
    reach = (
        classes.select("vec")
        .mapInArrow(_reach(sample, top + 1), "of int, score double")
        .withColumn("nth", nth)
        .filter(F.col("nth") <= top + 1)
        .groupBy("of")
        .agg(F.max("score"))
    )
    reach = np.array([r[1] for r in reach.collect()])  # one number of each sampled vector
    fitted = Tables.fit(reach, fact["dim"], fact["n"], tables, seed)
    index = stored(
        classes.select("id", "vec").mapInArrow(_index(fitted), f"id bigint, vec {kind}, keys array<bigint>"),
        "index",
    )
    asked = rows.filter(F.col("id") % every == 0)
    asked = stored(
        asked.join(classes.select("vec", F.col("id").alias("class")), "vec").select("id", "class", "vec"), "queries"
    )
    searched = asked.groupBy("class").agg(F.first("vec").alias("vec")).withColumnRenamed("class", "id")

    def probed(queries: DataFrame) -> DataFrame:
        found = queries.select("id", "vec", "radius").mapInArrow(
            _probe(fitted, success), f"id bigint, vec {kind}, keys array<bigint>, reached boolean"
        )
        return stored(found, "probes")

    probes = probed(searched.withColumn("radius", F.lit(fitted.radius)))
    hot = (
        index.select(F.explode("keys").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > HOT)
        .select("bucket", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    )
    hot = stored(hot, "hot")
    parts = F.coalesce("parts", F.lit(1))
    here = (
        index.select("id", "vec", F.explode("keys").alias("bucket"))
        .join(hot, "bucket", "left")
        .select("bucket", F.pmod(F.xxhash64("id"), parts).cast("int").alias("salt"), F.lit(1).alias("is_row"), "id", "vec")
    )
    nearest_first = Window.partitionBy("query").orderBy("score", "found")

    def compared(rows: DataFrame, queries: DataFrame) -> DataFrame:
        return (
            rows.unionByName(queries)
            .repartition("bucket", "salt")
            .sortWithinPartitions("bucket", "salt", "is_row")
            .mapInArrow(_compare(top + 1), "query bigint, found bigint, score double")
        )

    def met(probes: DataFrame) -> DataFrame:
        there = (
            probes.select("id", "vec", F.explode("keys").alias("bucket"))
            .join(hot, "bucket", "left")
            .select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).alias("is_row"), "id", "vec")
        )
        return compared(here, there)

    def against_all(queries: DataFrame) -> DataFrame:
        blocks = ceil(fact["n"] / HOT)
        place = lambda salt, is_row: [
            F.lit(0).cast("bigint").alias("bucket"), salt.cast("int").alias("salt"), F.lit(is_row).alias("is_row"), "id", "vec"
        ]
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        return compared(
            classes.select(*place(F.pmod(F.xxhash64("id"), F.lit(blocks)), 1)),
            queries.withColumn("block", every).select(*place(F.col("block"), 0)),
        )

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query", "found").agg(F.min("score").alias("score"))
        return once.withColumn("place", F.row_number().over(nearest_first)).filter(F.col("place") <= top + 1)

    near = stored(best(met(probes)).drop("place"), "near")
    sizes = classes.select(F.col("id").alias("found"), F.size("ids").alias("n_ids"))
    reach = (
        near.join(sizes, "found")
        .withColumn("n_found", F.sum("n_ids").over(nearest_first))
        .groupBy(F.col("query").alias("id"))
        .agg(F.min(F.when(F.col("n_found") > top, F.col("score"))).alias("radius"))
    )
    state = probes.select("id", "vec", "reached").join(reach, "id", "left")
    state = stored(state.filter(F.col("radius").isNull() | (F.col("radius") > fitted.radius) | ~F.col("reached")), "badly")
    farther = state.filter("radius is not null").withColumn("radius", F.greatest("radius", F.lit(fitted.radius)))
    again = probed(farther)
    rest = state.filter("radius is null").select("id", "vec").unionByName(again.filter("not reached").select("id", "vec"))
    near = best(near.unionByName(met(again.filter("reached"))).unionByName(against_all(rest)))
    members = classes.select(F.col("id").alias("found"), "ids")
    per_query = (
        near.join(members, "found")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .join(asked.select("class", F.col("id").alias("query_id")), F.col("query") == F.col("class"))
        .filter(F.col("vec_id") != F.col("query_id"))
    )
    ranks = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        per_query.withColumn("rank", F.row_number().over(ranks).cast("int"))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
