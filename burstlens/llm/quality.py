"""Quality rules: zstandard ratios in bands that depend on length.

Repetitive text shrinks far more than prose of its length, text without structure (random
characters, encoded data) hardly shrinks. Short texts carry the frame of the format, so the
limits depend on the number of bytes.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from dataclasses import dataclass
from math import ceil, floor, isinf, log
from operator import itemgetter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm.common import map_texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
SIZES = (32, 50, 75, 100, 150, 200, 300, 400, 600, 800, 1200, 1600, 2048, 3200, 6400, 12800, 25600, 51200)
LIMITS = (
    (32, 1.187, float("inf")),
    (50, 1.08, float("inf")),
    (75, 0.826, 1.12),
    (100, 0.75, 1.022),
    (150, 0.68, 0.887),
    (200, 0.645, 0.815),
    (300, 0.603, 0.754),
    (400, 0.585, 0.728),
    (600, 0.563, 0.672),
    (800, 0.523, 0.624),
    (1200, 0.495, 0.573),
    (1600, 0.482, 0.543),
    (2048, 0.47, 0.526),
    (3200, 0.454, 0.495),
    (6400, 0.431, 0.467),
    (12800, 0.41, 0.45),
    (25600, 0.39, 0.44),
    (51200, 0.354, 0.423),
)


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / raw bytes. ``limits`` has (bytes, low, high).

    Between two sizes the limits are interpolated over the logarithm of the size; beyond the
    ends they stay; a size without a limit has none up to the next one. A document fails if its whole-text ratio is outside the band of its length,
    or if chunks outside theirs hold at least ``chunk_share`` of its bytes. The numbers are
    ``fit_limits`` of clean labelled prose: the texts of sf0.1 with label quality 1 that pass
    the base rule, by lang, then doc_id.
    """

    limits: tuple[tuple[int, float, float], ...] = LIMITS
    chunk_bytes: int = 2048
    chunk_share: float = 0.5
    level: int = 3
    min_words: int = 10
    max_repeat_percent: int = 20

    def of(self, size: int) -> tuple[float, float]:
        at = bisect(self.limits, size, key=itemgetter(0))
        if at in (0, len(self.limits)):
            return self.limits[max(at - 1, 0)][1:]
        (a, *here), (b, *after) = self.limits[at - 1 : at + 1]
        part = log(size / a) / log(b / a)
        between = (x if isinf(x) else x + part * (y - x) for x, y in zip(here, after, strict=True))
        return tuple(between)


def packer(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def fit_limits(
    texts: list[bytes], sizes: tuple[int, ...] = SIZES, level: int = 3, most: int = 4000, tail: float = 0.2
) -> tuple[tuple[int, float, float], ...]:
    """Limits that leave ``tail`` percent of the prose of each size outside on either side.

    Prose of a size is the first and the last bytes of at most ``most`` texts, and whole texts
    of within a tenth of it; where fewer than 60 texts are that long, pieces of all joined.
    Up to 50 bytes nothing shrinks, so these sizes have no high limit.
    """
    pack, found = packer(level), []
    for size in sizes:
        long = [t for t in texts if len(t) >= size][:most]
        cut = [c for t in long for c in (t[:size], t[-size:])]
        cut += [t for t in texts if size / 1.1 <= len(t) <= size * 1.1][:most]
        if len(long) < 60:
            joined = b"\n".join(texts)
            cut += [joined[i : i + size] for i in range(0, len(joined) - size + 1, size)][:most]
        ratios = sorted(len(pack.compress(c)) / len(c) for c in cut)
        skip = int(len(ratios) * tail / 100)
        low, high = floor(1000 * ratios[skip]) / 1000, ceil(1000 * ratios[-1 - skip]) / 1000
        found.append((size, low, high if size > 50 else float("inf")))
    return tuple(found)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("odd_share", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("kept", T.BooleanType()),
]


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the list."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + width - max(start, end)
            end = start + width
    return covered


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands | None = None
) -> DataFrame:
    """Word and line counts, compression ratios and the verdict for each row.

    Null and empty texts have no words and fail the base rule; their ratio is null. Equal rows
    get equal results, every row is judged on its own, and columns other than key and text are
    not looked at.
    """
    bands = bands or Bands()

    def work(texts: list) -> list:
        pack = packer(bands.level)

        def ratio(raw: bytes) -> float:
            return len(pack.compress(raw)) / len(raw)

        def outside(raw: bytes, value: float) -> int:
            low, high = bands.of(len(raw))
            return -1 if value < low else int(value > high)

        def judge(text: str | None) -> tuple:
            raw = (text or "").encode()
            words = raw.split()
            bare = raw.translate(None, SPACES)
            n_repeat = repeated_words(words)
            failed = (
                len(words) < bands.min_words
                or 100 * n_repeat > bands.max_repeat_percent * len(words)
            )
            whole, odd, reason = None, 0.0, None
            if raw:
                whole = ratio(raw)
                side = outside(raw, whole)
                if side:
                    reason = "repetitive" if side < 0 else "incompressible"
                if len(raw) > bands.chunk_bytes:
                    size = bands.chunk_bytes
                    chunks = [raw[i : i + size] for i in range(0, len(raw), size)]
                    sides = [(outside(c, ratio(c)), len(c)) for c in chunks]
                    odd = sum(n for s, n in sides if s) / len(raw)
                    if reason is None and odd >= bands.chunk_share:
                        low = sum(n for s, n in sides if s < 0)
                        many = 2 * low >= odd * len(raw)
                        reason = "repetitive chunks" if many else "incompressible chunks"
            return (
                len(words),
                len(bare.decode()),
                len(raw) - len(raw.translate(None, SYMBOLS)),
                repeated_lines(raw),
                n_repeat,
                failed,
                whole,
                odd,
                "base" if failed else reason,
                not failed and reason is None,
            )

        return list(zip(*map(judge, texts), strict=True))

    return map_texts(docs, key, text, FIELDS, work)


def keep_good(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands | None = None
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass.

    The verdict depends on the text alone, so it comes from a copy of the text column that
    travels through the rules in place of the key.
    """
    verdicts = quality_rules(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text")),
        "_row",
        "_text",
        bands,
    )
    return verdicts.filter("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
