"""Tokens of two tokenizers over the same text, brought into line by interval coalescing.

Tokens of both kinds are byte intervals. All intervals of a batch are sorted by start; where a
start reaches the running maximum of the ends before, no token of either kind reaches over, and
a new group begins. Within a group the same order gives the overlaps: as both kinds cover the
text without gaps, each place where a token starts has one token of either kind, and these
places are exactly the overlapping pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm.common import arrow_type, cuts, stored
from burstlens.llm.token_memo import Memo, byte_level, piece_bytes, piece_level, token_bytes
from burstlens.llm.token_memo import vocabulary_path

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
PASS_BYTES = 1_500_000
ID_BITS = 32  # a pair is A's id times 2**32 plus B's
# Pairs that are sent to every task: 4 million take about 100 MB. More are joined by shuffle.
BROADCAST_PAIRS = 4_000_000


class Spelling:
    """The bytes of each id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.ends = np.cumsum(self.size)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        inside = np.arange(int(size.sum())) - np.repeat(stop - size, size)
        return self.bytes[np.repeat(self.ends[ids] - size, size) + inside]


@dataclass
class Tokens:
    """Ids of all texts of a pass that align, and each one's bytes and text."""

    ids: np.ndarray
    end: np.ndarray  # in bytes of the whole pass
    doc: np.ndarray


@dataclass
class Groups:
    """Intervals in order of start (a before b), their groups, and the overlapping pairs."""

    ids: np.ndarray
    is_b: np.ndarray
    doc: np.ndarray
    opens: np.ndarray  # whether an interval begins a group
    pair_a: np.ndarray
    pair_b: np.ndarray
    pair_doc: np.ndarray


def coalesce(a: Tokens, b: Tokens) -> Groups:
    """Groups and overlaps of two sets of intervals that both cover the same bytes."""
    end = np.concatenate([a.end, b.end])
    start = np.concatenate([np.append(0, a.end[:-1])[: len(a.end)], np.append(0, b.end[:-1])[: len(b.end)]])
    is_b = np.repeat([False, True], [len(a.end), len(b.end)])
    order = np.lexsort((is_b, start))
    start, end, is_b = start[order], end[order], is_b[order]
    reach = np.maximum.accumulate(end)
    opens = np.ones(len(order), bool)
    opens[1:] = start[1:] >= reach[:-1]
    last = np.ones(len(order), bool)  # of the intervals that start at the same place
    last[:-1] = start[1:] != start[:-1]
    at_a = np.cumsum(~is_b)[last] - 1
    at_b = np.cumsum(is_b)[last] - 1
    ids = np.concatenate([a.ids, b.ids])[order]
    doc = np.concatenate([a.doc, b.doc])[order]
    return Groups(ids, is_b, doc, opens, a.ids[at_a], b.ids[at_b], a.doc[at_a])


def group_texts(g: Groups, n_docs: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each document: groups in order, in each A's ids, then B's."""
    if not len(g.ids):
        return [""] * n_docs
    group = np.cumsum(g.opens)
    order = np.lexsort((g.is_b, group))
    ids, is_b, group, doc = g.ids[order], g.is_b[order], group[order], g.doc[order]
    closes = np.append(group[1:] != group[:-1], True)
    turns = np.append(is_b[1:] != is_b[:-1], True) & ~closes
    ends = np.append(doc[1:] != doc[:-1], True)
    mark = np.where(ends, 3, np.where(closes, 2, np.where(turns, 1, 0)))
    # Each id with each of the marks that may follow it, written once for the ids at hand.
    coded, where = np.unique(ids * 4 + mark, return_inverse=True)
    words = [f"{c >> 2}{(',', '|', ';', '')[c & 3]}" for c in coded.tolist()]
    flat = np.array(words, object)[where].tolist()
    out, lo = [""] * n_docs, 0
    stops = np.flatnonzero(ends) + 1
    for d, hi in zip(doc[stops - 1].tolist(), stops.tolist(), strict=True):
        out[d] = "".join(flat[lo:hi])
        lo = hi
    return out


class Aligner:
    """Both vocabularies in a worker."""

    def __init__(self, name_a: str, name_b: str):
        import sentencepiece

        self.memo_a, self.memo_b = byte_level(name_a, plain_specials=True), piece_level(name_b)
        self.spell_a = Spelling(token_bytes(name_a))
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name_b))
        self.spell_b = Spelling(list(piece_bytes(model)))

    def tokens(self, texts: pa.Array) -> tuple[Tokens, Tokens]:
        """Tokens of the texts whose bytes both sides spell; other texts have none."""
        raw = [t.encode() for t in texts.to_pylist() if t]
        full = np.zeros(len(texts), np.int64)
        size = texts.cast(pa.binary()).fill_null(b"")
        full[:] = np.fromiter(map(len, size.to_pylist()), np.int64, len(texts))
        full += full > 0  # the space in front
        whole = np.frombuffer(b"".join(b" " + t for t in raw), np.uint8)
        sides = []
        for memo, spell in ((self.memo_a, self.spell_a), (self.memo_b, self.spell_b)):
            ids, counts = memo.encode(texts, lead=True)
            doc = np.repeat(np.arange(len(texts)), counts)
            sides.append((ids, doc, self.same(spell, ids, doc, full, whole), spell))
        good = (full > 0) & sides[0][2] & sides[1][2]
        found = []
        for ids, doc, _, spell in sides:
            keep = good[doc]
            ids, doc = ids[keep], doc[keep]
            found.append(Tokens(ids.astype(np.int64), np.cumsum(spell.size[ids]), doc))
        return found[0], found[1]

    @staticmethod
    def same(spell: Spelling, ids, doc, full, whole) -> np.ndarray:
        """Whether each text's ids spell exactly its bytes."""
        length = np.bincount(doc, spell.size[ids], len(full)).astype(np.int64)
        same = length == full
        spelled = spell.spell(ids[same[doc]])
        expected = whole[np.repeat(same, full)]
        differ = np.concatenate([[0], np.cumsum(spelled != expected)])
        ends = np.cumsum(np.where(same, full, 0))
        return same & (differ[ends] == differ[ends - np.where(same, full, 0)])


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary_a: str = VOCABULARY_A,
    vocabulary_b: str = VOCABULARY_B,
    keep_groups: bool = False,
) -> DataFrame:
    """Each document's token and group numbers, its groups' digest, and its overlapping pairs.

    ``pairs`` and ``times`` are the document's different pairs (see ID_BITS) and how often each
    overlaps; ``groups`` is the text that the digest stands for, with ``keep_groups``.

    Null and empty texts, and texts that the tokens of either side do not spell byte by byte,
    have no tokens. Repeated rows and null keys are rows of their own; texts of any length are
    aligned whole; an empty table gives no rows; other columns are not looked at.
    """
    fields = [
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType(), False)),
        T.StructField("times", T.ArrayType(T.LongType(), False)),
    ]
    if keep_groups:
        fields.append(T.StructField("groups", T.StringType()))
    schema = T.StructType([docs.schema[key], *fields])
    key_kind = arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary_a, vocabulary_b)
        for batch in batches:
            for lo, hi in cuts(batch.column(1), PASS_BYTES):
                rows = batch.slice(lo, hi - lo)
                n = len(rows)
                a, b = aligner.tokens(rows.column(1).cast(pa.string()))
                g = coalesce(a, b)
                texts = group_texts(g, n)
                many = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                # Documents are few in a pass, so they share a number with the place of a pair.
                coded, place = np.unique(g.pair_a << ID_BITS | g.pair_b, return_inverse=True)
                mixed = g.pair_doc * max(1, len(coded)) + place
                mixed, times = np.unique(mixed, return_counts=True)
                owner, pair = np.divmod(mixed, max(1, len(coded)))
                ends = np.cumsum(np.bincount(owner, minlength=n))
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                columns = [
                    rows.column(0).cast(key_kind),
                    pa.array(np.bincount(a.doc, minlength=n)),
                    pa.array(np.bincount(b.doc, minlength=n)),
                    pa.array(np.bincount(g.doc[g.opens], minlength=n)),
                    pa.array(np.bincount(g.pair_doc, minlength=n)),
                    pa.array(many),
                    pa.ListArray.from_arrays(offsets, pa.array(coded[pair])),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                ]
                if keep_groups:
                    columns.append(pa.array(texts))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, its ``count`` over all documents, and whether its B id has no higher one."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    counts = stored(counts, "pair-counts")
    b = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    best = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("b", b).join(best, "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def cross_align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary_a: str = VOCABULARY_A,
    vocabulary_b: str = VOCABULARY_B,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``align`` with how a document's pairs count in the whole corpus.

    ``n_best`` are links whose pair's count is the highest of its B id, ties included, and
    ``count_sum`` adds up the counts of all links. A table of at most ``broadcast_pairs`` pairs
    goes to every task, a larger one is joined by its pairs; the rows are the same.
    """
    names = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    numbered = align(docs, key, text, vocabulary_a, vocabulary_b)
    numbered = numbered.withColumn("row", F.monotonically_increasing_id())
    aligned = stored(numbered, "aligned")
    counts = stored(pair_counts(aligned), "pair-table")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    joined = each.join(counts, "pair")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    base = aligned.select("row", *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)])
    whole = base.join(sums, "row", "left")
    return whole.select(
        *[F.col(f"_{i}").alias(n) for i, n in enumerate(names)],
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
    )
