"""Whitening of embeddings by principal components that come from exact integers.

Entries become integers, so the scatter of the distinct vectors is an exact integer matrix,
summed by Spark. Tasks find its characteristic polynomial modulo one prime each, and later the
eigenvectors of one root each (``characteristic``); what the driver holds is as large as the
scatter matrix. Two passes over the vectors surround that: one sums, one projects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm import characteristic as ch
from burstlens.llm.common import arrow_type, stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
FAR = 2.0**62  # entries whose scaled value is not smaller have no 64-bit integer
LIMB = 1 << 60  # exact sums travel as two decimals: multiples of this, and the rest


def int_vectors(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """By vector length: row numbers, and ``floor(64 * c) + 1000000`` of their entries.

    Null and empty vectors, and those with null, non-finite or too large entries are left out.
    """
    lists = lists.cast(pa.list_(pa.float64()))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    odd = flat.is_null().to_numpy(zero_copy_only=False) | ~(np.abs(values) * SCALE < FAR)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(odd)])
    fit = (size > 0) & (bad[ends] == bad[ends - size])
    found = []
    for d in np.unique(size[fit]).tolist():
        rows = np.flatnonzero(fit & (size == d))
        at = (ends[rows] - d)[:, None] + np.arange(d)
        found.append((rows, np.floor(values[at] * SCALE).astype(np.int64) + OFFSET))
    return found


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct integer vector once, as ``x``."""
    schema = T.StructType([T.StructField("x", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in int_vectors(batch.column(0)):
                yield pa.RecordBatch.from_arrays([_lists(x)], names=["x"])

    return vectors.select(vector).mapInArrow(run, schema).distinct()


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(
    fit: DataFrame, cells: int, work: Callable[[pa.Array], np.ndarray]
) -> list[int]:
    """Sums over the fit list of ``cells`` integers that ``work`` gives for each batch.

    A task adds up its batches in unbounded integers and sends ``cells`` rows, so what meets
    is as many rows as cells for each task, and the driver gets one row for each cell.
    """
    schema = "cell int, high decimal(38,0), low decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, object)
        for batch in batches:
            total = total + work(batch.column(0)).astype(object)
        high, low = zip(*(divmod(int(v), LIMB) for v in total), strict=True)
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(cells, dtype=np.int32)),
                pa.array([Decimal(v) for v in high], kind),
                pa.array([Decimal(v) for v in low], kind),
            ],
            names=["cell", "high", "low"],
        )

    added = fit.mapInArrow(run, schema).groupBy("cell").agg(F.sum("high"), F.sum("low"))
    found = [0] * cells
    for cell, high, low in added.collect():
        found[cell] = int(high) * LIMB + int(low)
    return found


def products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` without rounding: in doubles, 64-bit or unbounded integers as they fit."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 2**53:
        return (z.T.astype(np.float64) @ z.astype(np.float64)).astype(np.int64)
    if most * most * len(z) < 2**63:
        return z.T @ z
    return z.T.astype(object) @ z.astype(object)


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, and the kept components."""

    d: int
    n: int
    sums: list[int]
    roots: np.ndarray  # of n * n * covariance, falling
    trace: int  # of the same matrix
    vectors: np.ndarray  # one row for each root

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: 64-bit integers if they fit, else unbounded ones."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Coordinates of unit variance from deviations: both carry the factor n."""
        return y.astype(np.float64) @ self.vectors.T / np.sqrt(self.roots)


def scatter(fit: DataFrame, d: int, n: int, sums: list[int]) -> list[list[int]]:
    """``n * sum(z z') - sum(z) sum(z)'``, which is n * n times the covariance, exactly.

    ``z`` is x less the integer next to its mean, so vectors are centred before they multiply;
    what that integer leaves of the mean is taken off exactly.
    """
    centre = np.array([(2 * s + n) // (2 * n) for s in sums])
    upper = np.triu_indices(d)

    def work(lists: pa.Array) -> np.ndarray:
        return products(_matrix(lists, d) - centre)[upper]

    found = exact_sums(fit, len(upper[0]), work)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    matrix = [[0] * d for _ in range(d)]
    for i, j, v in zip(*upper, found, strict=True):
        matrix[i][j] = matrix[j][i] = n * v - rest[i] * rest[j]
    return matrix


def characteristic(spark, matrix: list[list[int]]) -> list[int]:
    """The polynomial's coefficients; each task works modulo some primes of its own."""
    primes = ch.primes_needed(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rest = ch.char_residues(matrix, primes[i]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([primes[i]]), pa.array([rest])], names=["prime", "residues"]
                )

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(
        run, "prime bigint, residues array<bigint>"
    )
    return ch.combine({p: rest for p, rest in rows.collect()})


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The largest components of a fit list; None if no direction varies.

    Vectors of another length than most distinct ones have (ties: the longer) take no part.
    """
    spark = fit.sparkSession
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    if not (first := lengths.first()):
        return None
    d, n = first
    fit = fit.filter(F.size("x") == d)
    sums = exact_sums(fit, d, lambda lists: _sum(_matrix(lists, d)))
    matrix = scatter(fit, d, n, sums)
    poly = characteristic(spark, matrix)
    found = ch.isolate(poly, most)
    if not found:
        return None
    roots = [ch.refine(poly, *interval) for interval in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                vectors = ch.null_vectors(matrix, *roots[i], found[i][3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([vectors])], names=["id", "vectors"]
                )

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(
        run, "id bigint, vectors array<array<double>>"
    )
    by_root = {i: vectors for i, vectors in rows.collect()}
    values, vectors = [], []
    for i, (a, k) in enumerate(roots):
        for v in by_root[i]:
            values.append(a / (1 << k))
            vectors.append(v)
    trace = sum(matrix[i][i] for i in range(d))
    return Whitening(d, n, sums, np.array(values[:most]), trace, np.array(vectors[:most]))


def _sum(x: np.ndarray) -> np.ndarray:
    if int(np.abs(x).max(initial=0)) * len(x) < 2**63:
        return x.sum(axis=0)
    return x.astype(object).sum(axis=0)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k, d = len(model.roots), model.d
    schema = "cell int, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.whiten(model.deviations(_matrix(batch.column(0), d)))
            square += w.T @ w
            plain += w.sum(axis=0)
        values = np.concatenate([square.ravel(), plain])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
            names=["cell", "value"],
        )

    rows = fit.filter(F.size("x") == d).mapInArrow(run, schema).groupBy("cell")
    sums = np.zeros(k * k + k)
    for cell, value in rows.agg(F.sum("value")).collect():
        sums[cell] = value
    mean = sums[k * k :] / model.n
    cov = sums[: k * k].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    most: int = COMPONENTS,
) -> DataFrame:
    """One row for each vector and component, up to ``most`` components.

    ``n`` is the number of distinct integer vectors x, ``deviation`` the exact sum of
    ``(n * x - sum) ** 2`` over dimensions as a decimal (null beyond 38 digits), ``whitened``
    the vector's coordinate, ``explained`` the component's share of the variance, and
    ``identity_error`` how far the whitened fit list is from unit covariance.

    Vectors that are null or empty, hold null, non-finite or too large entries, or have another
    length than most have no rows. Components without variance are not given: a table whose
    distinct vectors are none or one has no rows. Repeated rows and null keys are rows of their
    own, equal vectors count once in the fit. Equal eigenvalues share a space of which fixed
    starts choose the axes. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key]
    schema = T.StructType(
        [
            kind,
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    fit = stored(fit_list(vectors, vector), "distinct-vectors")
    model = fit_whitening(fit, most)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model)
    k = len(model.roots)
    explained = model.roots / model.trace
    key_kind = arrow_type(kind.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in int_vectors(batch.column(1)):
                if x.shape[1] != model.d:
                    continue
                y = model.deviations(x)
                wide = int(np.abs(y).max(initial=0)) ** 2 * model.d >= 2**63
                exact = y.astype(object) if wide else y
                deviation = [
                    Decimal(v) if v < 10**38 else None for v in (exact * exact).sum(axis=1).tolist()
                ]
                each = np.repeat(np.arange(len(rows)), k)
                parts = np.tile(np.arange(k), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[each])).cast(key_kind),
                        pa.array((parts + 1).astype(np.int32)),
                        pa.array(np.full(len(each), model.n)),
                        pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(model.whiten(y).ravel()),
                        pa.array(explained[parts]),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=schema.names,
                )

    return vectors.select(key, vector).mapInArrow(run, schema)
