"""Near-duplicates by ProbMinHash over weighted five-word shingles.

Each shingle is a Poisson process whose rate is its count; an arrival claims a random register
if it is the earliest there. Arrivals later than the latest claimed register can change
nothing, so a shingle ends with its first such arrival. Two texts agree in a register with
their probability Jaccard similarity, which does not change if one repeats all it says.

Registers are hashed in bands. Texts that share a bucket are linked to a few leading members of
it, not to each other; candidates whose registers agree often enough are verified exactly.
That only makes classes fewer: the last step compares the sketches of all pairs that share a
bucket and are still in different classes, so that no link is left to chance. It verifies pairs
where it meets them and passes on only links that join classes, so what leaves a task is less
than the rows that enter it.
Equal word sequences are one text from the start, and only their first row goes further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm.common import cuts, mix64, stored, uniform
from burstlens.llm.repeats import WordHashes, gram_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6  # two texts of similarity 0.8 share a bucket with probability 0.999
PART = 512  # rows of a bucket that are compared at once with as many of other classes
PAIRS = 1_000_000  # pairs of one numpy pass; only memory depends on it
HELD = 2_000_000  # shingles that a task keeps at hand for further pairs; only memory depends on it
_NO_KEY = -(2**63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = (0, -1, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)  # xor with these puts rows in other orders
_EDGES = "a bigint, b bigint"


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle."""
    if not len(words):
        return words
    return mix64(gram_hashes(words, min(WORDS, len(words))))


def registers(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """The element with the earliest arrival in each register of each text."""
    earliest = np.full(n_texts * size, np.inf)
    winner = np.zeros(n_texts * size, np.uint64)
    time = np.zeros(len(element))
    alive = np.arange(len(element))
    latest = np.full(n_texts, np.inf)
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(alive):
            e, t = element[alive], text[alive]
            turn += np.uint64(1)
            draw = mix64(e + turn * _STEP)
            now = time[alive] - np.log(uniform(draw)) / weight[alive]
            time[alive] = now
            slot = t * size + (mix64(draw ^ _STEP) % np.uint64(size)).astype(np.int64)
            np.minimum.at(earliest, slot, now)
            won = earliest[slot] == now
            winner[slot[won]] = e[won]
            some = np.unique(t)
            latest[some] = earliest.reshape(n_texts, size)[some].max(1)
            alive = alive[now < latest[t]]
    return winner.reshape(n_texts, size)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Exact probability Jaccard similarity of two (sorted distinct elements, counts)."""
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    ratio, n = np.unique(b[1][at_b] / a[1][at_a], return_counts=True)
    only_a = a[1].sum() - a[1][at_a].sum()
    only_b = b[1].sum() - b[1][at_b].sum()
    x, y = a[1][at_a], b[1][at_b]
    share = [y[y / x == r].sum() / (np.maximum(x * r, y).sum() + only_a * r + only_b) for r in ratio]
    return float(np.sum(share))


def _signatures(bands: int, rows: int):
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        names = ["row", "doc", "tie", "words", "n_words", "bands", "sketch"]
        for batch in batches:
            for lo, hi in cuts(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                found, counts, digests, lengths = [], [], [], []
                for t in part.column(3).to_pylist():
                    words = (t or "").encode().split()
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    lengths.append(len(words))
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    e, n = np.unique(shingles(hashes), return_counts=True)
                    found.append(e)
                    counts.append(n)
                text = np.repeat(np.arange(len(found)), list(map(len, found)))
                winner = registers(
                    np.concatenate(found), np.concatenate(counts).astype(float), text, len(found), size
                )
                banded = winner.reshape(-1, bands, rows)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), banded.shape[:2]).copy()
                    for i in range(rows):
                        key = mix64(key * _STEP + banded[:, :, i])
                keys = pa.array(key.view(np.int64).reshape(-1))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands)
                sketch = (mix64(winner) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array(digests, pa.binary()),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, keys),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=names,
                )

    return run


def _alike(least: float):
    """Pairs whose registers agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _sketches(batch.column(2)), _sketches(batch.column(3))
            yield batch.filter(pa.array((a == b).sum(1) >= _agreeing(least, a.shape[1]))).select([0, 1])

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _agreeing(least: float, size: int) -> float:
    """Equal bytes of a sketch that ``least`` stands for; a byte may agree by chance."""
    return size * (least * (1 - 1 / 256) + 1 / 256)


class _Weighted:
    """Shingles and counts of the texts at hand."""

    def __init__(self):
        self.known, self.last, self.held = WordHashes(), {}, 0

    def __call__(self, row: int, text: str) -> tuple:
        if row not in self.last:
            if self.held > HELD:
                self.last.clear()
                self.held = 0
            words = text.encode().split()
            hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            self.last[row] = np.unique(shingles(hashes), return_counts=True)
            self.held += len(words)
        return self.last[row]


def _similarities(x: tuple, others: list[tuple]) -> np.ndarray:
    """``probability_jaccard`` of one text with others, at once where no shingle repeats."""
    if (x[1] != 1).any():
        return np.array([probability_jaccard(x, y) for y in others])
    sizes = np.array([len(y[0]) for y in others])
    joined = np.concatenate([y[0] for y in others])
    at = np.searchsorted(x[0], joined)
    hit = x[0][np.minimum(at, len(x[0]) - 1)] == joined
    shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
    found = shared / (len(x[0]) + sizes - shared)
    for i, y in enumerate(others):
        if len(y[0]) != y[1].sum():
            found[i] = probability_jaccard(x, y)
    return found


def _linked(least: float, slack: float):
    """Links that join classes of a cell: some rows of a bucket, and some that ask for partners.

    A pair belongs to the first of the buckets that its texts share. Classes that a link joins
    are one for the pairs after it, so links are fewer than classes.
    """

    def cell(weighted: _Weighted, bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, label = rows["row"].to_numpy(), rows["label"].to_numpy()
        asker = rows["asker"].to_numpy()
        sketch = _sketches(rows["sketch"])
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        band = int((bands[0] == bucket).argmax())
        texts = rows["text"]
        targets, askers = np.flatnonzero(rows["is_row"].to_numpy()), np.flatnonzero(rows["asks"].to_numpy())
        parent = {c: c for c in set(label.tolist())}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        agreeing = _agreeing(least - slack, sketch.shape[1])
        columns = sketch[targets].T.copy()
        links = []
        for y in askers.tolist():
            agree = np.zeros(len(targets), np.uint16)
            for k, theirs in enumerate(sketch[y].tolist()):
                agree += columns[k] == theirs
            x = targets[(agree >= agreeing) & (label[targets] != label[y])]
            # Two askers meet twice, unless one of them does not ask.
            x = x[~asker[x] | (ids[x] < ids[y])]
            x = x[(bands[x] == bands[y]).argmax(1) == band]
            mine = root(int(label[y]))
            x = [i for i in x.tolist() if root(int(label[i])) != mine]
            if not x:
                continue
            one = weighted(int(ids[y]), texts[y].as_py())
            near = _similarities(one, [weighted(int(ids[i]), texts[i].as_py()) for i in x])
            for i in np.flatnonzero(near >= least).tolist():
                other, mine = root(int(label[x[i]])), root(int(label[y]))
                if other != mine:
                    parent[other] = mine
                    links.append(sorted((int(ids[x[i]]), int(ids[y]))))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = _Weighted()
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                key = tuple(int(k[lo]) for k in keys)
                if held and key != current:
                    yield from cell(weighted, current[0], pa.Table.from_batches(held))
                    held = []
                current = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from cell(weighted, current[0], pa.Table.from_batches(held))

    return run


def _verified(least: float):
    """Pairs whose exact similarity reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = _Weighted()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [
                probability_jaccard(
                    weighted(a[i], batch.column(2)[i].as_py()), weighted(b[i], batch.column(3)[i].as_py())
                )
                >= least
                for i in range(batch.num_rows)
            ]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``row`` and ``label`` of every linked row: equal for rows that links join.

    Every row points to its smallest neighbour; pointers are followed to their ends by jumps,
    each of which doubles their reach, so a chain of n rows takes log(n) of them. Links then
    move to where their rows point; those within a class vanish, so each turn leaves far fewer.
    """
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = stored(
            both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("row"), F.least("a", "m").alias("to")),
            "moves",
        )
        while True:
            onward = moves.select(F.col("row").alias("to"), F.col("to").alias("next")).filter("to <> next")
            far = moves.join(onward, "to", "left")
            if far.filter("next IS NOT NULL").isEmpty():
                break
            moves = stored(far.select("row", F.coalesce("next", "to").alias("to")), "moves")
        if labels is None:
            labels = moves.select("row", F.col("to").alias("label"))
        else:
            step = moves.select(F.col("row").alias("label"), "to")
            labels = stored(
                labels.join(step, "label", "left").select("row", F.coalesce("to", "label").alias("label")), "labels"
            )
        left = moves.select(F.col("row").alias("a"), F.col("to").alias("x"))
        right = moves.select(F.col("row").alias("b"), F.col("to").alias("y"))
        edges = stored(
            edges.join(left, "a")
            .join(right, "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
    if labels is None:
        return edges.select(F.col("a").alias("row"), F.col("b").alias("label"))
    return labels


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after further links, of which there are few: only classes they touch change."""
    left = labels.select(F.col("row").alias("a"), F.col("label").alias("x"))
    right = labels.select(F.col("row").alias("b"), F.col("label").alias("y"))
    ends = edges.join(left, "a", "left").join(right, "b", "left")
    between = ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")
    between = between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    step = components(stored(between.distinct(), "links"))
    to = step.select(F.col("row").alias("label"), F.col("label").alias("to"))
    moved = labels.join(to, "label", "left").select("row", F.coalesce("to", "label").alias("label"))
    unknown = step.join(labels.select("row"), "row", "left_anti")
    return stored(moved.unionByName(unknown), "labels")


def _pairs(rows: DataFrame) -> DataFrame:
    return (
        rows.filter("row <> other")
        .select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))
        .distinct()
    )


def _rest(banded: DataFrame, shared: DataFrame, labels: DataFrame, some: DataFrame, bodies: DataFrame, least: float, slack: float) -> DataFrame:
    """Links between rows that share a bucket, not a class, which join all such classes.

    Rows of a bucket that are not of its largest class ask; rows and askers are dealt to cells
    of PART and PART, so that no task holds more of a bucket, and each pair meets in a cell.
    """
    labelled = shared.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    mixed = (
        labelled.groupBy("bucket", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("bucket")
        .agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
        .filter("classes > 1")
        .select(
            "bucket",
            F.col("most.label").alias("most"),
            F.ceil(F.col("n") / PART).cast("int").alias("parts"),
            F.ceil((F.col("n") - F.col("most.n")) / PART).cast("int").alias("chunks"),
        )
    )
    facts = some.select("row", "sketch").join(banded, "row").join(bodies, "row")
    asker = F.col("label") != F.col("most")
    members = labelled.join(mixed, "bucket").withColumns(
        {
            "asker": asker,
            "p": F.pmod(F.xxhash64("row"), "parts").cast("int"),
            "q": F.pmod(F.xxhash64("row", F.lit(1)), "chunks").cast("int"),
        }
    )
    as_row = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda q: F.struct(F.col("p").alias("p"), q.alias("q"), F.lit(True).alias("is_row"), (F.col("asker") & (q == F.col("q"))).alias("asks")),
    )
    as_asker = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("asker") & (p != F.col("p"))),
        lambda p: F.struct(p.alias("p"), F.col("q").alias("q"), F.lit(False).alias("is_row"), F.lit(True).alias("asks")),
    )
    cells = members.select("bucket", "row", "label", "asker", F.explode(F.concat(as_row, as_asker)).alias("cell"))
    placed = cells.join(facts, "row").select(
        "bucket", "cell.p", "cell.q", "row", "label", "asker", "cell.is_row", "cell.asks", "sketch", "bands", "text"
    )
    order = ("bucket", "p", "q")
    sorted_ = placed.repartition(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(_linked(least, slack), _EDGES).distinct()


def near_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``key``, ``class_id`` (smallest key of its class), ``is_first``, ``n_words``, ``tie``.

    Texts are in a class if links of ``similarity`` or more join them. Exactly one row of a
    class is first: the smallest key, among equal keys by a hash of the text. ``key`` must be
    integral; null counts as the smallest. Null and empty texts, and texts of white space, have
    no words and are classes of their own. Texts of one to four words are in a class if their
    words are equal. Other columns are not looked at; an empty table gives no rows.
    """
    given = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)).alias("doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"),
        F.col(text).alias("text"),
    )
    schema = T.StructType.fromDDL(
        "row bigint, doc bigint, tie bigint, words binary, n_words bigint, bands array<bigint>, sketch binary"
    )
    signed = stored(
        given.select(F.monotonically_increasing_id().alias("row"), "doc", "tie", "text").mapInArrow(
            _signatures(bands, rows), schema
        ),
        "signatures",
    )
    worded = signed.filter("n_words > 0")
    at = F.min(F.struct("doc", "tie", "row")).alias("first")
    first = stored(worded.groupBy("words").agg(at).select("words", "first.*"), "firsts")
    texts = stored(
        worded.select("row", "bands", "sketch").join(first.select("row", "doc", "tie"), "row"), "distinct"
    )

    banded = texts.select("row", F.explode("bands").alias("bucket"))
    orders = [F.min(F.col("row").bitwiseXOR(F.lit(o))).alias(f"m{i}") for i, o in enumerate(_ORDERS)]
    sizes = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("n"), *orders)
        .filter("n > 1")
        .select("bucket", *[F.col(f"m{i}").bitwiseXOR(F.lit(o)).alias(f"m{i}") for i, o in enumerate(_ORDERS)])
    )
    met = stored(banded.join(sizes, "bucket"), "buckets")
    shared = met.select("bucket", "row")
    concerned = shared.select("row").distinct()
    some = stored(texts.join(concerned, "row").select("row", "doc", "tie", "sketch"), "candidates")
    bodies = stored(
        given.join(some.select("row", "doc", "tie").hint("merge"), ["doc", "tie"])  # alike at every size
        .dropDuplicates(["doc", "tie"])  # repeated rows are one text
        .select("row", F.coalesce("text", F.lit("")).alias("text")),
        "bodies",
    )
    sketches = some.select("row", "sketch")
    slack = 4 * (similarity * (1 - similarity) / (bands * rows)) ** 0.5

    def verified(alike: DataFrame) -> DataFrame:
        sure = _sides(alike, bodies, "text").mapInArrow(_verified(similarity), _EDGES).distinct()
        return stored(sure, "edges")

    def checked(pairs: DataFrame) -> DataFrame:
        return verified(_sides(pairs, sketches, "sketch").mapInArrow(_alike(similarity - slack), _EDGES))

    leaders = F.array_distinct(F.array(*[F.col(f"m{i}") for i in range(len(_ORDERS))]))
    pairs = stored(_pairs(met.select("row", F.explode(leaders).alias("other"))), "pairs")
    labels = components(checked(pairs))
    rest = _rest(texts.select("row", "bands"), shared, labels, some, bodies, similarity, slack)
    labels = _joined(labels, stored(rest, "edges"))

    # Copies follow their first row, which follows its class's first row.
    lead = (
        labels.join(first.select("row", "doc", "tie"), "row")
        .groupBy("label")
        .agg(F.min(F.struct("doc", "tie", "row")).alias("lead"))
    )
    moved = labels.join(lead, "label").select("row", "lead")
    own = first.join(moved, "row", "left").select(
        "words", F.coalesce("lead", F.struct("doc", "tie", "row")).alias("lead")
    )
    alone = signed.filter("n_words = 0").select(
        "row", "doc", "tie", "n_words", F.struct("doc", "tie", "row").alias("lead")
    )
    every = (
        worded.select("row", "doc", "tie", "n_words", "words")
        .join(own, "words")
        .drop("words")
        .unionByName(alone)
    )
    kind = docs.schema[key].dataType
    known = lambda c: F.when(c != _NO_KEY, c).cast(kind)
    return every.select(
        known(F.col("doc")).alias(key),
        known(F.col("lead.doc")).alias("class_id"),
        (F.col("row") == F.col("lead.row")).alias("is_first"),
        "n_words",
        "tie",
    )


def _sides(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """``a``, ``b`` and the column of either side."""
    left = facts.select(F.col("row").alias("a"), F.col(column).alias("left"))
    right = facts.select(F.col("row").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def first_of_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are first of their class, with all their columns.

    Of rows equal in key and text one stays.
    """
    chosen = (
        near_classes(docs, key, text, **options)
        .filter("is_first")
        .select(F.col(key).alias("_key"), F.col("tie").alias("_tie"), F.lit(True).alias("_chosen"))
    )
    # The caller's row travels as one value, so that no name of its columns can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    words = F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", "")), F.lit(0))
    named = docs.select(
        whole.alias("given"),
        F.col(f"`{key}`").alias("_key0"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("_tie0"),
        (words == 0).alias("_wordless"),
    )
    both = named.join(chosen, named["_key0"].eqNullSafe(chosen["_key"]) & (named["_tie0"] == chosen["_tie"]), "left_semi")
    twin = F.row_number().over(Window.partitionBy("_key0", "_tie0").orderBy("_tie0"))
    return (
        both.withColumn("_nth", twin)
        .filter((F.col("_nth") == 1) | F.col("_wordless"))
        .select("given.*")
    )
