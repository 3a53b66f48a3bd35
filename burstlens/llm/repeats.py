"""Windows that occur more than once in a corpus: what both substring operators share.

A text is a row of units (bytes, or words), a window is ``width`` units in a row. Equal windows
must meet without moving every window, so a window goes where its anchor goes: of the
``gram``-unit strings inside it, the leftmost with the smallest hash. The anchor depends on the
window's content alone, and neighbouring windows mostly share it: the windows of one occurrence
of an anchor travel as one context (``width`` plus a few units).

1. Each text is hashed and cut into anchors once; that slim table is written.
2. A range sort by anchor shows which occur again. Whole copies are set aside by their hash.
3. Contexts of repeated anchors meet by anchor and a kernel finds the equal windows among them.
   Of equal contexts only the first goes on, of those that one task reads already before they
   meet. Anchors with more than ``HOT`` occurrences, or at the border of a range, are split by
   what stands beside them: half of the windows share the units after the anchor, the others
   those before it, so anchor and units together are a longer anchor. Anchors that still have
   more than ``HOT`` different contexts are split again, until windows are their own anchors.
   A range border may fall inside an anchor, so that no anchor is bound to one task.
4. Covered units are cut out of the texts that had repeated anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm.common import cuts, mix64, stored

HOT = 1_000  # different contexts of an anchor that one kernel call may hold
CHUNK = 1 << 18  # window starts that one numpy pass handles
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(28)
_LOW = np.uint64((1 << 28) - 1)
_NO_KEY = -(2**63)  # stands for a null key, which sorts first


class ByteUnits:
    """Texts as UTF-8 bytes."""

    item = 1

    def raw(self, text: str | None) -> np.ndarray:
        return np.frombuffer((text or "").encode(), np.uint8)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        return raw.astype(np.uint64)

    def sha(self, text: str | None, drop: np.ndarray | None = None) -> str:
        """Hash of what is left of a text without the units of ``drop``."""
        raw = self.raw(text)
        return hashlib.sha256(raw.tobytes() if drop is None else raw[~drop].tobytes()).hexdigest()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordUnits:
    """Texts as words, each a 64-bit hash."""

    item = 8

    def __init__(self) -> None:
        self.known = WordHashes()

    def raw(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        return raw

    def sha(self, text: str | None, drop: np.ndarray | None = None) -> str:
        words = (text or "").encode().split()
        if drop is not None:
            words = [words[i] for i in np.flatnonzero(~drop).tolist()]
        return hashlib.sha256(b" ".join(words)).hexdigest()


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of each run of ``gram`` values, by doubling."""
    with np.errstate(over="ignore"):
        done, out, span, power, factor = 0, None, 1, values, _BASE
        left = gram
        while True:
            if left & 1:
                if out is None:
                    out = power
                else:
                    n = len(values) - done - span + 1
                    out = out[:n] * factor + power[done : done + n]
                done += span
            left >>= 1
            if not left:
                return out
            n = len(values) - 2 * span + 1
            power = power[:n] * factor + power[span : span + n]
            factor = factor * factor
            span *= 2


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    n, have = len(values) - span + 1, 1
    while 2 * have <= span:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[span - have : span - have + n])


def anchors(hashes: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> tuple:
    """Text, first window, number of windows and hash of each anchor occurrence.

    ``hashes`` has the units of all texts end to end. Each window start belongs to exactly one
    occurrence; only the windows' content decides which strings are anchors.
    """
    ends = np.cumsum(lengths)
    found = []
    for lo in range(0, max(len(hashes) - width + 1, 0), CHUNK):
        part = hashes[lo : lo + CHUNK + width - 1]
        n = len(part) - width + 1
        mixed = mix64(gram_hashes(part, gram))
        place = np.arange(len(mixed), dtype=np.uint64)
        best = sliding_min((mixed >> _PLACE_BITS << _PLACE_BITS) | place, width - gram + 1)
        first = int(np.searchsorted(ends, lo, side="right"))
        last = int(np.searchsorted(ends, lo + n - 1, side="right"))
        own = np.diff(np.clip(ends[first : last + 1], None, lo + n), prepend=lo)
        text = np.repeat(np.arange(first, last + 1), own)
        start = np.flatnonzero(np.arange(lo, lo + n) + width <= ends[text])
        if not len(start):
            continue
        at = (best[start] & _LOW).astype(np.int64)
        runs = np.flatnonzero(np.diff(at, prepend=-1))
        head, doc = start[runs] + lo, text[start[runs]]
        count = np.diff(runs, append=len(start))
        found.append((doc, head - (ends - lengths)[doc], count, mixed[at[runs]]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _slim(docs: DataFrame, units: Callable, width: int, gram: int) -> DataFrame:
    """One row per text: size, hash and anchors."""
    schema = T.StructType.fromDDL(
        "row bigint, doc bigint, tie bigint, n bigint, sha string,"
        " a array<bigint>, start array<int>, windows array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units()
        for batch in batches:
            for lo, hi in cuts(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(3).to_pylist()
                raws = [u.raw(t) for t in texts]
                lengths = np.array([len(r) for r in raws], np.int64)
                doc, start, windows, a = anchors(u.hashes(np.concatenate(raws)), lengths, width, gram)
                counts = np.bincount(doc, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array(lengths),
                        pa.array([u.sha(t) for t in texts]),
                        _lists(a.astype(np.uint64).view(np.int64), counts, pa.int64()),
                        _lists(start, counts, pa.int32()),
                        _lists(windows, counts, pa.int32()),
                    ],
                    names=schema.names,
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc", "tie", "text")
    return stored(rows.mapInArrow(run, schema), "anchors")


def _repeated(most: int):
    """Of rows sorted by anchor, those whose anchor occurs again, and whether it is hot.

    The first and the last anchor of a partition may go on in the next one; they count as hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "a", "start", "windows", "hot"]
        held: list[pa.RecordBatch] = []
        first = hot = None

        def emit(table: pa.Table, pick: np.ndarray, is_hot: np.ndarray) -> Iterator[pa.RecordBatch]:
            if pick.any():
                chosen = table.filter(pa.array(pick)).append_column(
                    "hot", pa.array(is_hot[pick])
                )
                yield from chosen.select(names).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            a = table.column("a").to_numpy()
            if first is None:
                first = a[0]
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            size = np.diff(starts, append=len(a))
            is_hot = (size > most) | (a[starts] == first)
            if hot is not None:
                is_hot |= a[starts] == hot
            cut = starts[-1]
            if is_hot[-1]:  # more of it may come, but it is decided
                hot, cut = a[-1], len(a)
            whole = np.repeat(is_hot, size)[:cut]
            pick = (whole | np.repeat(size > 1, size)[:cut])
            yield from emit(table.slice(0, cut), pick, whole)
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            rest = pa.Table.from_batches(held)
            every = np.ones(rest.num_rows, bool)
            yield from emit(rest, every, every)

    return run


# A context whose anchor is ``core`` units from ``pos`` on (-1: never split); ``key`` brings those
# with the same anchor together. Without a context, the row's windows are known to be later ones.
_WORK = (
    "key bigint, doc bigint, tie bigint, row bigint, start int, windows int, pos int, core int, context binary"
)
_NAMES = ["key", "doc", "tie", "row", "start", "windows", "pos", "core", "context"]
_BATCH_BYTES = 4_000_000  # of texts whose contexts are compared before they meet others


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def halves(windows: np.ndarray, pos: np.ndarray, core: np.ndarray, width: int) -> tuple:
    """Contexts of an anchor as contexts of two longer ones: index, first window, windows, pos, core.

    A window has ``width - core`` units beside its anchor, so it holds half of them before the
    anchor or half of them after it; its place among the windows says which.
    """
    rest = width - core
    before = rest // 2 + 1
    left = np.clip(pos - before + 1, 0, windows)
    zero = np.zeros_like(left)
    parts = (
        np.concatenate([zero, left]),
        np.concatenate([left, windows - left]),
        np.concatenate([pos - before, pos - left]),
        np.concatenate([core + before, core + rest - rest // 2]),
    )
    index = np.tile(np.arange(len(windows)), 2)
    some = parts[1] > 0
    return tuple(x[some] for x in (index, *parts))


def _hash_keys(made: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, made), np.uint64, len(made)).view(np.int64)


def _work(columns: list, context: pa.Array) -> pa.RecordBatch:
    kinds = [np.int64] * 4 + [np.int32] * 4
    arrays = [pa.array(np.asarray(c).astype(t)) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, context], names=_NAMES)


def _later(row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Windows of these rows, by row and place, as known to be later ones; neighbours are joined."""
    end = start + windows  # contexts of a text do not share windows
    new = np.flatnonzero((np.diff(row, prepend=row[:1] - 1) != 0) | (start != np.concatenate([[-1], end[:-1]])[: len(row)]))
    last = np.append(new[1:], len(row)) - 1 if len(new) else new
    none = np.zeros(len(new), np.int64)
    key = mix64((row[new] + start[new]).astype(np.uint64)).view(np.int64)  # deals them out
    columns = [key, none, none, row[new], start[new], end[last] - start[new], none - 1, none]
    return _work(columns, pa.nulls(len(new), pa.binary()))


def _contexts(units: Callable, width: int, gram: int):
    """Contexts of the repeated anchors of each text, equal ones once; hot anchors are split."""

    def made(u, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, doc, tie = (np.asarray(batch.column(k)) for k in range(3))
        raws = [u.raw(t) for t in batch.column(3).to_pylist()]
        marks = batch.column(4).flatten()
        counts = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(row)), counts)
        key, start, windows = (np.asarray(marks.field(f)).astype(np.int64) for f in ("a", "start", "windows"))
        hot = marks.field("hot").to_numpy(zero_copy_only=False)
        base = np.cumsum([0, *map(len, raws)])
        raw = np.concatenate(raws)
        size, data = raw.itemsize, raw.tobytes()
        pos, core = np.full(len(of), -1), np.zeros(len(of), np.int64)
        split = np.flatnonzero(hot)
        if len(split):
            mixed = mix64(gram_hashes(u.hashes(raw), gram)) >> _PLACE_BITS
            begin = (base[of] + start)[split]
            place = np.concatenate(
                [
                    mixed[begin[i : i + 10_000, None] + np.arange(width - gram + 1)].argmin(axis=1)
                    for i in range(0, len(begin), 10_000)
                ]
            )
            index, first, n, at, long = halves(windows[split], place, np.full(len(split), gram), width)
            x = begin[index] + first + at
            keys = _hash_keys(
                [data[i:j] for i, j in zip((x * size).tolist(), ((x + long) * size).tolist(), strict=True)]
            )
            cold = ~hot
            of = np.concatenate([of[cold], of[split][index]])
            start = np.concatenate([start[cold], start[split][index] + first])
            windows, key = np.concatenate([windows[cold], n]), np.concatenate([key[cold], keys])
            pos, core = np.concatenate([pos[cold], at]), np.concatenate([core[cold], long])
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((row, tie, doc))] = np.arange(len(row))
        order = np.lexsort((start, rank[of]))
        of, start, windows, key, pos, core = (x[order] for x in (of, start, windows, key, pos, core))
        lo = (base[of] + start) * size
        hi = lo + (windows - 1 + width) * size
        contexts = pa.array([data[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
        first, later = _equal(contexts, row[of], start)
        if len(later):
            yield _later(row[of][later], start[later], windows[later])
        columns = [x[first] for x in (key, doc[of], tie[of], row[of], start, windows, pos, core)]
        yield _work(columns, contexts.take(pa.array(first)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units()
        for batch in batches:
            for lo, hi in cuts(batch.column(3), _BATCH_BYTES):
                yield from made(u, batch.slice(lo, hi - lo))

    return run


def _equal(contexts: pa.Array, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts in order of occurrence, the first of each, and those that equal an earlier one.

    Equal contexts have the same anchor. A row that came twice is no other one.
    """
    code = contexts.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else code
    lead = first[code]
    return first, np.flatnonzero((row != row[lead]) | (start != start[lead]))


def _settle(kernel: Callable, width: int, item: int, chunk_units: int, most: int):
    """Windows to remove, from contexts sorted by anchor and order of occurrence.

    Contexts of an anchor that has more than ``most`` different ones come back split.
    """
    kind = np.uint8 if item == 1 else np.uint64

    def split(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(k).to_numpy().astype(np.int64) for k in range(1, 8)]
        contexts = table.column(8).to_pylist()
        index, first, n, at, long = halves(*columns[4:], width)
        made, cores = [], []
        steps = (index, first * item, (first + n - 1 + width) * item, (first + at) * item, (first + at + long) * item)
        for i, x, y, begin, end in zip(*(s.tolist() for s in steps), strict=True):
            made.append(contexts[i][x:y])
            cores.append(contexts[i][begin:end])
        moved = [c[index] for c in columns[:3]]
        return _work([_hash_keys(cores), *moved, columns[3][index] + first, n, at, long], pa.array(made, pa.binary()))

    def distinct(table: pa.Table) -> tuple[pa.Table, list[pa.RecordBatch]]:
        """The first of equal contexts, and what is settled by them."""
        row, start, windows = (table.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
        first, later = _equal(table.column(8).combine_chunks(), row, start)
        by_place = later[np.lexsort((start[later], row[later]))]
        found = [_later(row[by_place], start[by_place], windows[by_place])] if len(later) else []
        return table.take(pa.array(first)), found

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table, found = distinct(table)
        yield from found
        key, doc, tie, row, start, windows, pos, core = (table.column(k).to_numpy() for k in range(8))
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        n_same = np.bincount(group)[group]
        much = (n_same > most) & (pos >= 0) & (core < width)
        if much.any():
            yield split(table.filter(pa.array(much)))
        # Equal windows share their anchor, so the one context of an anchor has no partner.
        several = np.flatnonzero((n_same > 1) & ~much)
        if not len(several):
            return
        contexts = table.column(8).combine_chunks()
        sizes = windows[several].astype(np.int64) - 1 + width
        begins = np.flatnonzero(np.diff(group[several], prepend=-1))
        part = (np.cumsum(sizes) - sizes)[begins] // chunk_units
        edges = [*begins[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(several)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = several[lo:hi]
            texts = [np.frombuffer(x, kind) for x in contexts.take(pa.array(own)).to_pylist()]
            owned = windows[own].astype(np.int64)
            text = np.repeat(own, owned)
            ends = np.cumsum(owned)
            place = start[text] + np.arange(len(text)) - np.repeat(ends - owned, owned)
            order = np.empty(len(text), np.int64)
            order[np.lexsort((place, row[text], tie[text], doc[text]))] = np.arange(len(text))
            again = kernel(texts, owned, order)
            # Runs end with their context: a False stands between any two.
            gaps = np.insert(again, ends, False)
            x, y = runs_of(gaps)
            at = np.searchsorted(ends + np.arange(len(ends)), x, side="right")
            shift = start[own][at] - (ends - owned)[at] - at
            if len(x):
                rows, begin = row[own][at], x + shift
                by_place = np.lexsort((begin, rows))
                yield _later(rows[by_place], begin[by_place], (y - x)[by_place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        over = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=_NAMES)
            yield batch.filter(batch.column(8).is_null())
            batch = batch.filter(batch.column(8).is_valid())
            same = batch.column(0).to_numpy() == over if over is not None else np.zeros(batch.num_rows, bool)
            if same.any():
                yield split(pa.Table.from_batches([batch.filter(pa.array(same))]))
                batch = batch.filter(pa.array(~same))
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            before = np.flatnonzero(key != key[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield from solve(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()  # the last anchor may go on
            if rest.num_rows > most:
                rest, found = distinct(rest)
                yield from found
                if rest.num_rows > most and rest.column(6)[0].as_py() >= 0 and rest.column(7)[0].as_py() < width:
                    over = key[-1]
                    yield split(rest)
                    rest = rest.slice(0, 0)
            held = rest.to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _cut_out(units: Callable):
    """Sizes and hash of what is left of each text without the ranges given for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row, text, ranges = (c[i] for c in batch.columns)
                text = text.as_py()
                depth = np.zeros(len(u.raw(text)) + 1, np.int64)
                lo = np.asarray(ranges.values.field("lo"))
                hi = np.asarray(ranges.values.field("hi"))
                np.add.at(depth, lo, 1)
                np.add.at(depth, hi, -1)
                drop = np.cumsum(depth)[:-1] > 0
                starts, ends = runs_of(drop)
                spans = [{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                rows.append((row.as_py(), int(drop.sum()), u.sha(text, drop), spans))
            if rows:
                spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                kinds = (pa.int64(), pa.int64(), pa.string(), spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["row", "n_removed", "kept_sha256", "spans"],
                )

    return run


def remove_repeats(
    docs: DataFrame,
    kernel: Callable,
    units: Callable,
    width: int,
    gram: int,
    key: str,
    text: str,
    chunk_units: int,
) -> DataFrame:
    """``key``, ``n`` units, ``n_removed``, ``spans`` of removed units and ``kept_sha256``.

    A unit goes if a window over it also starts earlier: in a text with a smaller key, or
    earlier in the same text. ``key`` must be integral; a null key counts as the smallest.
    Texts with the same key are ordered by a hash; of rows equal in key and text the first one
    counts as earlier and they may be swapped. Null and empty texts have no units.
    """
    rows = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)).alias("doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"),
        F.col(text).alias("text"),
    )
    slim = _slim(rows, units, width, gram)
    first = F.min(F.struct("doc", "tie", "row")).alias("first")
    originals = slim.groupBy("sha").agg(first).select("first.*")

    marks = slim.select(
        "row", F.explode(F.arrays_zip("a", "start", "windows")).alias("m")
    ).select("row", "m.*")
    sorted_ = marks.repartitionByRange("a", "row").sortWithinPartitions("a", "row")
    again = sorted_.mapInArrow(
        _repeated(HOT), "row bigint, a bigint, start int, windows int, hot boolean"
    )
    per_row = again.groupBy("row").agg(
        F.collect_list(F.struct("a", "start", "windows", "hot")).alias("marks")
    )
    wanted = stored(originals.join(per_row, "row"), "marks")
    concerned = stored(
        rows.join(wanted.hint("merge"), ["doc", "tie"]).select("row", "doc", "tie", "text", "marks"), "repeats"
    )
    work = concerned.mapInArrow(_contexts(units, width, gram), _WORK)
    solve = _settle(kernel, width, units.item, chunk_units, HOT)
    lo, hi = F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1 + width).alias("hi")
    ranges = None
    while ranges is None or not work.isEmpty():  # anchors grow to whole windows in a few rounds
        met = work.repartition("key").sortWithinPartitions("key", "doc", "tie", "row", "start")
        done = stored(met.mapInArrow(solve, _WORK), "ranges")
        found = done.filter("context IS NULL").select("row", lo, hi)
        ranges = found if ranges is None else ranges.unionByName(found)
        work = done.filter("context IS NOT NULL")
    per_text = ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    changed = (
        concerned.select("row", "text")
        .join(per_text.hint("merge"), "row")
        .mapInArrow(
            _cut_out(units),
            "row bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>",
        )
        .dropDuplicates(["row"])
    )
    kind = docs.schema[key].dataType
    is_first = originals.select("row", F.lit(True).alias("original"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    copy = F.col("original").isNull() & (F.col("n") >= width)
    empty_sha = hashlib.sha256(b"").hexdigest()
    return (
        slim.select("row", "doc", "n", "sha")
        .join(is_first, "row", "left")
        .join(changed, "row", "left")
        .select(
            F.when(F.col("doc") != _NO_KEY, F.col("doc")).cast(kind).alias(key),
            "n",
            F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
            F.when(copy, empty_sha).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )
