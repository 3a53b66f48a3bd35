"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The lattice of a text has a node between any two characters and an arc for each vocabulary
piece that fits. Forward filtering sums the weight of all ways to reach a node; backward
sampling then draws one piece after the other from the end, each in proportion to the ways
that lead through it, so a segmentation is drawn by its exact probability. Uniforms are hashes
of seed, row key and character offset: the same row gets the same segmentation on any machine.

A piece can have the space mark only in front, so nodes before a mark cut the lattice; words
are filtered once per distinct word of a pass and sampled once per occurrence. Vocabularies of
merges carry ranks, not probabilities; a piece of rank r weighs ``1 / ((r + 1) * H)``, which
is Zipf's law, to the power ``alpha``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from burstlens.llm.common import arrow_type, cuts, mix64, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # the vocabulary's mark for a space
PLAIN_MARK = "\ud800"  # stands for a mark that the text itself has; no text can hold it
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_PASS = 1_000_000  # bytes of text in one pass


@dataclass
class Pieces:
    """A vocabulary: pieces by id, the ids of single bytes, and the weight of each piece."""

    pieces: list[str]
    byte_ids: list[int]
    log_weight: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = 1.0) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        byte_ids, usable = [0] * 256, []
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(_BYTE.fullmatch(piece)[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usable.append(i)
        total = np.sum(1.0 / np.arange(1, len(usable) + 1))
        weight = np.full(len(pieces), -np.inf)
        weight[usable] = -alpha * np.log(np.arange(1, len(usable) + 1) * total)
        return cls(pieces, byte_ids, weight)

    def automaton(self):
        """All pieces as a search automaton, built once in each Python worker."""
        if not hasattr(self, "_automaton"):
            import ahocorasick

            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i in np.flatnonzero(np.isfinite(self.log_weight)):
                piece = self.pieces[i]
                found.add_word(piece, int(i) * 64 + len(piece))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def byte_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and where each id's begin."""
        if not hasattr(self, "_bytes"):
            raw = [p.replace(MARK, " ").encode() for p in self.pieces]
            for value, i in enumerate(self.byte_ids):
                raw[i] = bytes([value])
            ends = np.cumsum([0, *map(len, raw)])
            self._bytes = np.frombuffer(b"".join(raw), np.uint8), ends
        return self._bytes


def _lattice(words: list[str], vocab: Pieces) -> tuple:
    """Arcs of all words, sorted by end node, and the forward-filtered nodes.

    Word w has nodes ``first[w] .. first[w] + len(w)``. Characters outside the vocabulary get an
    arc with id -1, which stands for their bytes.
    """
    joined = "".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.repeat(np.arange(len(words)), lengths)  # word of each character
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    hits = chain.from_iterable(vocab.automaton().iter(joined))
    ends, values = np.fromiter(hits, np.int64).reshape(-1, 2).T
    size, ids = values % 64, values // 64
    begins = ends - size + 1
    same = chars[np.maximum(begins, 0)] == chars[ends]
    begins, ends, ids = begins[same], ends[same], ids[same]
    weight = vocab.log_weight[ids]
    covered = np.zeros(len(joined), bool)
    covered[ends[begins == ends]] = True
    bare = np.flatnonzero(~covered)
    if len(bare):
        worst = vocab.log_weight[np.isfinite(vocab.log_weight)].min()
        begins, ends = np.concatenate([begins, bare]), np.concatenate([ends, bare])
        ids = np.concatenate([ids, np.full(len(bare), -1)])
        weight = np.concatenate([weight, np.full(len(bare), 2 * worst)])
    # The node after character c of word w is c + w + 1, the one before it c + w.
    tail, head = begins + chars[begins], ends + chars[ends] + 1
    order = np.argsort(head, kind="stable")
    tail, head, ids, weight = tail[order], head[order], ids[order], weight[order]
    log_sum = np.zeros(len(joined) + len(words))
    depth = head - first[chars[ends[order]]]
    by_depth = np.argsort(depth, kind="stable")
    steps = np.flatnonzero(np.diff(depth[by_depth], prepend=-1, append=-1))
    if len(by_depth):
        steps = np.unique(np.concatenate([steps, [0, len(by_depth)]]))
    for lo, hi in zip(steps[:-1], steps[1:], strict=True):
        arcs = by_depth[lo:hi]
        value = log_sum[tail[arcs]] + weight[arcs]
        starts = np.flatnonzero(np.diff(head[arcs], prepend=-1))
        most = np.maximum.reduceat(value, starts)
        count = np.diff(starts, append=len(arcs))
        total = np.add.reduceat(np.exp(value - np.repeat(most, count)), starts)
        log_sum[head[arcs[starts]]] = most + np.log(total)
    # Each arc's share of its end node, summed up within the node.
    share = np.exp(log_sum[tail] + weight - log_sum[head])
    summed = np.cumsum(share)
    starts = np.flatnonzero(np.diff(head, prepend=-1))
    count = np.diff(starts, append=len(head))
    base = np.repeat(np.where(starts > 0, summed[starts - 1], 0.0), count)
    within = np.clip(summed - base, 0.0, 1.0)
    within[np.concatenate([starts[1:], [len(head)]]) - 1] = 1.0
    return tail.astype(np.int32), ids.astype(np.int32), head + within - 1.0, first, lengths


class Lattice:
    """Filtered words of the passes so far; forgotten as a whole beyond ``KEEP`` words."""

    KEEP = 250_000

    def __init__(self, vocab: Pieces):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tail, self.ids = np.empty(0, np.int32), np.empty(0, np.int32)
        self.key = np.empty(0)
        self.first, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.nodes = 0

    def add(self, words: list[str]) -> None:
        """Appends words that are not filtered yet."""
        if not words:
            return
        tail, ids, key, first, lengths = _lattice(words, self.vocab)
        self.tail = np.concatenate([self.tail, tail + np.int32(self.nodes)])
        self.ids = np.concatenate([self.ids, ids])
        self.key = np.concatenate([self.key, key + self.nodes])
        self.first = np.concatenate([self.first, first + self.nodes])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.nodes += int(lengths.sum()) + len(words)


def encode(texts: list, seeds: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts end to end, and how many each text has.

    A text gets a mark in front, as the vocabulary's own encoder does; an empty one has no ids.
    """
    marked = [
        MARK + t.replace(MARK, PLAIN_MARK).replace(" ", MARK) if t else "" for t in texts
    ]
    vocab = lattice.vocab
    if len(lattice.known) > lattice.KEEP:
        lattice.clear()
    known, before = lattice.known, len(lattice.known)
    occurrences: list[int] = []
    for t in marked:
        occurrences += [known.setdefault(w, len(known)) for w in _WORD.findall(t)]
    lattice.add(list(islice(known, before, None)))
    text_len = np.fromiter(map(len, marked), np.int64, len(marked))
    text_start = np.cumsum(text_len) - text_len
    if not occurrences:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    tail, ids, key = lattice.tail, lattice.ids, lattice.key
    first, lengths = lattice.first, lattice.lengths
    word = np.array(occurrences)
    end = np.cumsum(lengths[word])  # in characters of all texts
    owner = np.repeat(np.arange(len(texts)), text_len)[end - 1]
    slot = np.full(int(text_len.sum()), -2, np.int64)
    # Where an occurrence's node stands in the text is the node plus a constant.
    shift = end - (first[word] + lengths[word])
    node, stop = first[word] + lengths[word], first[word]
    with np.errstate(over="ignore"):
        while len(node):
            offset = (node + shift - text_start[owner]).astype(np.uint64)
            draw = uniform(mix64(seeds[owner] + mix64(offset)))
            arc = np.searchsorted(key, node - 1 + draw, side="left")
            node = tail[arc]
            slot[node + shift] = ids[arc]
            left = node > stop
            if not left.all():
                node, stop, shift, owner = node[left], stop[left], shift[left], owner[left]
    at = np.flatnonzero(slot > -2)
    found = slot[at]
    of_text = np.repeat(np.arange(len(texts)), text_len)[at]
    bare = np.flatnonzero(found == -1)
    if len(bare):
        joined = "".join(marked)
        spelled = [
            [vocab.byte_ids[b] for b in joined[c].replace(PLAIN_MARK, MARK).encode()]
            for c in at[bare].tolist()
        ]
        width = np.ones(len(found), np.int64)
        width[bare] = list(map(len, spelled))
        begin = np.cumsum(width) - width
        out = np.repeat(found, width)
        for n in range(4):
            some = width[bare] > n
            out[begin[bare[some]] + n] = [s[n] for s in spelled if len(s) > n]
        found, of_text = out, np.repeat(of_text, width)
    return found.astype(np.int32), np.bincount(of_text, minlength=len(texts))


def decode(ids: np.ndarray, counts: np.ndarray, vocab: Pieces) -> list[str]:
    """The texts that the ids spell; the mark in front of each is dropped."""
    table, ends = vocab.byte_table()
    size = ends[ids + 1] - ends[ids]
    total = np.cumsum(size)
    inside = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)
    raw = table[np.repeat(ends[ids], size) + inside].tobytes()
    last = np.cumsum(counts)
    stops = np.concatenate([[0], total])
    return [
        raw[stops[e - n] + (n > 0) : stops[e]].decode() for n, e in zip(counts, last, strict=True)
    ]


def row_seeds(keys: list, seed: int) -> np.ndarray:
    """A 64-bit seed for each row key."""
    import xxhash

    return np.array(
        [xxhash.xxh3_64_intdigest(repr(k).encode(), seed=seed) for k in keys], np.uint64
    )


def sample_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    model: str = MODEL,
    alpha: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """``key``, ``ids`` and ``n_ids`` of each row, and ``lossless``: decoding gives the text.

    Null texts have null ids and count 0; empty texts have no ids. Equal rows get the same
    segmentation, since only key, seed and offset steer it; rows with a null key share a seed.
    Texts of any length are encoded whole; other columns are not looked at.
    """
    vocab = Pieces.load(model, alpha)
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_ids", T.LongType()),
            T.StructField("lossless", T.BooleanType()),
        ]
    )
    kind = arrow_type(docs.schema[key].dataType)

    def run(batches):
        lattice = Lattice(vocab)
        for batch in batches:
            for lo, hi in cuts(batch.column(1), _PASS):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                ids, counts = encode(texts, row_seeds(part.column(0).to_pylist(), seed), lattice)
                back = decode(ids, counts, vocab)
                same = [t is None or t == b for t, b in zip(texts, back, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                missing = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(ids), mask=missing
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(kind), lists, pa.array(counts), pa.array(same)],
                    names=schema.names,
                )

    return docs.select(key, text).mapInArrow(run, schema)


def decode_pieces(
    encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL
) -> DataFrame:
    """``key`` and ``text`` of encoded rows; null ids give a null text."""
    vocab = Pieces.load(model)
    schema = T.StructType([encoded.schema[key], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = np.array([len(r or ()) for r in rows], np.int64)
            flat = np.array([i for r in rows for i in r or ()], np.int64)
            texts = decode(flat, counts, vocab)
            texts = [None if r is None else t for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=schema.names
            )

    return encoded.select(key, ids).mapInArrow(run, schema)
