"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

The contexts of a bucket are dealt to shards and each shard's rotations are sorted once. The
merge never compares suffixes: the interleave (the shard of each place of the merged order)
starts as one shard after the other and is refined step by step. A step reads each shard's
transform in the order of the interleave and deals the places out by symbol, stably; then the
interleave is right for suffixes one symbol longer. Places where a new block begins give the
common prefixes; blocks that are left when ``width`` bytes are sorted are the repeated
intervals. A symbol is ten bytes, so ten steps sort 100 bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm.repeats import ByteUnits, remove_repeats

WIDTH = 100
GRAM = 32
STEP = 10  # bytes of a symbol
SHARDS = 4
CHUNK_BYTES = 60_000  # of contexts that one merge takes; anchors are not divided
_SEPARATOR, _END = 0xFE, 0xFF  # bytes that UTF-8 never has


def rotations(symbols: np.ndarray) -> np.ndarray:
    """Order of all rotations of a text whose last symbol occurs once, by doubling."""
    n = len(symbols)
    rank = packed(symbols, 7).astype(np.int64) if symbols.dtype == np.uint8 else symbols
    span = 7 if symbols.dtype == np.uint8 else 1
    order = np.argsort(rank)
    while True:
        value = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(value, prepend=value[0]) != 0)
        if rank[order[-1]] == n - 1:
            return order
        rank = rank * n + np.roll(rank, -span)
        order = np.argsort(rank)
        span *= 2


def packed(text: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 8) bytes from each place on, as one number; the text is a ring."""
    ring = np.concatenate([text, text[: size - 1]])
    out = np.zeros(len(text), np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | ring[i : i + len(text)]
    return out


def merge_shards(texts: list[np.ndarray], width: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Interleaved order of all rotations by their first ``width`` bytes.

    Gives the order of each shard, the merged place of each shard's rotations (one shard after
    the other), the number of the block of each place, and the bytes (in steps of ``STEP``)
    that each place has in common with the place before; -1 stands for ``width`` or more.
    """
    orders = [rotations(t) for t in texts]
    grams = []
    for text, order in zip(texts, orders, strict=True):
        grams.append(packed(text, 8)[order - STEP])  # the ring's bytes before each rotation
    # Ten bytes are the number of the first eight among all, and two more.
    _, front = np.unique(np.concatenate(grams), return_inverse=True)
    back = np.concatenate(
        [packed(t, 2)[o - (STEP - 8)] for t, o in zip(texts, orders, strict=True)]
    )
    known, transform = np.unique((front.astype(np.uint64) << np.uint64(16)) | back, return_inverse=True)
    transform = transform.astype(np.uint16 if len(known) <= 1 << 16 else np.int64)
    shard = np.repeat(np.arange(len(texts), dtype=np.uint8), [len(t) for t in texts])
    n = len(shard)
    block, common = np.zeros(n, np.int32), np.full(n, -1, np.int32)
    common[0] = 0
    symbol = np.empty_like(transform)
    for step in range(width // STEP):
        symbol[np.argsort(shard, kind="stable")] = transform
        deal = np.argsort(symbol, kind="stable")
        shard, dealt, block = shard[deal], symbol[deal], block[deal]
        new = np.concatenate(
            [[False], (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])]
        )
        common[new & (common < 0)] = step * STEP
        block = np.cumsum(new, dtype=np.int32)
    return orders, np.argsort(shard, kind="stable"), block, common


def repeated_windows(texts: list, owned: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which of the windows at the first ``owned`` places of each text also occur earlier.

    ``order`` has the order of occurrence of these windows, text by text.
    """
    n_shards = min(SHARDS, len(texts))
    groups = np.array_split(np.arange(len(texts)), n_shards)
    joined, base = [], []
    for group in groups:
        parts = []
        at = 0
        for i in group:
            base.append(at)
            parts += [texts[i], np.array([_SEPARATOR], np.uint8)]
            at += len(texts[i]) + 1
        joined.append(np.concatenate([*parts, np.array([_END], np.uint8)]))
    orders, place, block, _ = merge_shards(joined, width)
    offset = np.cumsum([0, *map(len, joined)])
    block_at = np.empty(offset[-1], np.int32)
    for k, own in enumerate(orders):
        block_at[offset[k] + own] = block[place[offset[k] : offset[k + 1]]]
    shard_of = np.repeat(np.arange(n_shards), [len(g) for g in groups])
    begin = np.array(base) + offset[shard_of]
    text = np.repeat(np.arange(len(texts)), owned)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(owned) - owned, owned)
    interval = block_at[begin[text] + nth]
    first = np.full(int(block[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, interval, order)
    return order > first[interval]


def dedup_suffixes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``spans`` and ``kept_sha256`` of every row.

    Removes each byte under a 100-byte string that also starts earlier; see
    ``repeats.remove_repeats`` for ties, nulls and repeated rows. Other columns are not looked
    at; an empty table gives no rows.
    """
    found = remove_repeats(docs, repeated_windows, ByteUnits, WIDTH, GRAM, key, text, CHUNK_BYTES)
    return found.withColumnRenamed("n", "n_bytes")


def suffix_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )
