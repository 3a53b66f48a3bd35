"""Near-duplicate classes and neighbour search against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burstlens.llm import near, p_stable
from burstlens.llm.mixing import mix_sources
from burstlens.llm.near import first_of_classes, near_classes, probability_jaccard, registers
from burstlens.llm.p_stable import nearest
from burstlens.llm.pii import find_pii
from burstlens.llm.quality import keep_good


def exact(a, b):
    return sum(
        1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in a.keys() | b.keys()) for d in a.keys() & b.keys()
    )


def pair(rng, n):
    common = {int(x): int(rng.integers(1, 4)) for x in rng.integers(0, 10**9, n)}
    a = common | {int(x): 1 for x in rng.integers(0, 10**9, n // 5)}
    b = {k: v + (k % 7 == 0) for k, v in common.items()} | {int(x): 2 for x in rng.integers(0, 10**9, n // 9)}
    return a, b


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = pair(rng, 60)
    sides = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)], float)) for s in (a, b)]
    assert probability_jaccard(*sides) == pytest.approx(exact(a, b))
    element, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
    text = np.repeat([0, 1], [len(a), len(b)])
    found = registers(element, weight, text, 2, 4096)
    assert (found[0] == found[1]).mean() == pytest.approx(exact(a, b), abs=0.035)
    again = registers(element, weight * 5, text, 2, 4096)  # the scale of the counts is irrelevant
    assert (found == again).all()


def test_classes_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(40, 150))
        docs.append(base)
        for _ in range(4):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(words)
            docs.append(other)
    texts = [" ".join(d) for d in docs] + ["", None, " \n", "one two", "one  two", "one two three"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[9], "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    counts = []
    for _, t, _ in rows:
        w = (t or "").split()
        counts.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if counts[i] and counts[j] and exact(counts[i], counts[j]) >= 0.8:
                label[root(i)] = root(j)
    order = lambda i: -1 if rows[i][0] is None else rows[i][0]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 10**9), order(i))
    expected = sorted((order(i), least[root(i)]) for i in range(len(rows)))
    found = near_classes(df).collect()
    assert sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1]) for r in found) == expected
    firsts = [r for r in found if r["is_first"]]
    assert len(firsts) == len(least)
    kept = first_of_classes(df)
    assert kept.columns == df.columns and kept.count() == len(least)
    assert near_classes(df.limit(0)).count() == 0 and first_of_classes(df.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[200:900] = x[100]  # a hot vector
    rows = [(i, x[i].tolist(), 1) for i in range(1500)]
    rows += [(1600, None, 1), (1700, [0.0] * 16, 1), (1800, [float("nan")] * 16, 1), (1900, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, ids int")
    found = {}
    for r in nearest(df).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    wide = x.astype(np.float64)
    hits = 0
    assert sorted(found) == list(range(0, 1500, 100))
    for q, got in found.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert sorted(got) == list(range(1, 11))
        pairs = [got[k] for k in range(1, 11)]
        assert pairs == sorted(pairs, key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(d[v], rel=1e-12) for v, s in pairs)
        hits += len({v for v, _ in pairs} & set(best.tolist()))
    assert hits >= 0.9 * 150
    assert [found[100][k][0] for k in range(1, 11)] == list(range(200, 210))
    assert nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r)[:3] for r in nearest(few).collect()] == [(0, 1, 5)]


def test_equally_near_rows_go_by_key(spark):
    """Binary vectors, far more of them equally near than are asked for, some far from the origin."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for shift in (0.0, 1e6):
        x = bits.astype(np.float64) + shift
        x[0] += shift == 0  # no zero vector
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = {}
        for r in nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        for q in (100, 200):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            best = np.lexsort((np.arange(256), d))[:10]
            assert [got[q][k] for k in range(1, 11)] == [(int(i), d[i]) for i in best]


def test_rounding_keeps_the_nearest():
    """Far from the origin the rough distances of near rows are all alike, and some overflow."""
    rng = np.random.default_rng(3)
    for scale, shift in ((1e-3, 1e6), (1.0, 0.0), (1e160, 0.0)):
        x = rng.standard_normal((300, 6)) * scale + shift
        ids = np.concatenate([[1000], np.arange(300)])
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(301, np.int64)), pa.array(np.zeros(301, np.int32)),
                pa.array(np.arange(301) > 0).cast(pa.int32()), pa.array(ids), pa.array([x[7].tolist(), *x.tolist()]),
            ],
            names=["bucket", "salt", "is_row", "id", "vec"],
        )
        with np.errstate(over="ignore", invalid="ignore"):
            (out,) = p_stable._compare(5)([batch])
            d = np.sqrt(((x - x[7]) ** 2).sum(1))
        assert out.column(1).to_pylist() == np.lexsort((np.arange(300), d))[:5].tolist()


def test_later_links_join_classes(spark):
    """Labels after later links name the same classes as all links at once."""
    first, later = [(1, 2), (3, 4), (5, 6)], [(2, 3), (7, 8), (6, 9)]
    edges = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")

    def classes(labels):
        found = {}
        for r in labels.collect():
            found.setdefault(r["label"], set()).add(r["row"])
        return sorted(map(sorted, found.values()))

    step = near._joined(near.components(edges(first)), edges(later))
    assert classes(step) == [[1, 2, 3, 4], [5, 6, 9], [7, 8]]
    assert classes(near.components(edges(first + later))) == classes(step)
    assert classes(near._joined(near.components(edges([])), edges(later))) == [[2, 3], [6, 9], [7, 8]]


def test_no_link_is_left_to_the_draw(spark, monkeypatch):
    """Planted pairs of 0.8 or more in a family just below it are found with one leader."""
    rng = random.Random(5)
    common = [f"t{i}" for i in range(300)]
    texts = []
    for n in range(30):
        shared = [f"p{n}x{i}" for i in range(16)]
        texts += [" ".join(common + shared + [f"u{n}s{side}x{i}" for i in range(32)]) for side in (0, 1)]
    order = list(range(60))
    rng.shuffle(order)
    df = spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id bigint, text string")
    monkeypatch.setattr(near, "_ORDERS", (0,))
    monkeypatch.setattr(near, "PART", 16, raising=False)
    classes = {}
    for r in near_classes(df).collect():
        classes.setdefault(r["class_id"], set()).add(order[r["doc_id"]] // 2)
    assert sorted(map(sorted, classes.values())) == [[n] for n in range(30)]


def test_badly_served_queries_are_completed(spark):
    """Queries in sparse regions, and tables with few rows, get all their neighbours."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 16))
    x[::100] *= 3
    few = rng.standard_normal((11, 16))
    for vectors, least in ((x, 7), (few, 10)):
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        got = {}
        for r in nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        for q in range(0, len(vectors), 100):
            d = ((vectors - vectors[q]) ** 2).sum(1)
            d[q] = np.inf
            assert len(got[q]) == 10
            assert len(got[q] & set(np.argsort(d)[:10].tolist())) >= least


def families(rng, count, size, changes):
    """Texts near and below the similarity limit, so that buckets hold many classes."""
    words = [f"w{i}" for i in range(5000)]
    for _ in range(count):
        base = rng.choices(words, k=120)
        for _ in range(size):
            other = list(base)
            for at in rng.sample(range(120), rng.choice(changes)):
                other[at] = rng.choice(words)
            yield " ".join(other)


def brute_classes(texts):
    counts = []
    for t in texts:
        w = t.split()
        counts.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(counts[i] & counts[j])
            if shared >= 0.8 * (len(counts[i]) + len(counts[j]) - shared):
                label[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(root(i), i)
    return [least[root(i)] for i in range(len(texts))]


@pytest.mark.parametrize("part", [7, 512])
def test_many_classes_of_a_bucket(spark, monkeypatch, part):
    """All links between classes that share buckets are found, over cells of any size."""
    monkeypatch.setattr(near, "PART", part)
    texts = list(families(random.Random(8), 3, 60, (1, 2, 3, 4)))
    expected = brute_classes(texts)
    assert 3 < len(set(expected)) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in near_classes(df).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_a_cell_passes_on_fewer_links_than_rows(spark):
    import pyarrow as pa

    texts = list(families(random.Random(9), 1, 40, (0, 1)))
    n = len(texts)
    rows = pa.table(
        {
            "bucket": pa.array([5] * n), "p": pa.array([0] * n, pa.int32()), "q": pa.array([0] * n, pa.int32()),
            "row": pa.array(range(n)), "label": pa.array(range(n)), "asker": pa.array([i > 0 for i in range(n)]),
            "is_row": pa.array([True] * n), "asks": pa.array([i > 0 for i in range(n)]),
            "sketch": pa.array([bytes(144)] * n), "bands": pa.array([[5] * 24] * n), "text": pa.array(texts),
        }
    )
    links = [l for b in near._linked(0.8, 0.1)(rows.to_batches(max_chunksize=7)) for l in zip(*b.to_pydict().values(), strict=True)]
    assert 20 < len(links) < n and len({frozenset(l) for l in links}) == len(links)


def test_chains_take_few_jumps(spark, monkeypatch):
    from burstlens.llm import near as module

    written = []
    real = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name="stored": written.append(name) or real(df, name))
    chain = spark.range(999).selectExpr("id AS a", "id + 1 AS b")
    labels = {r.row: r.label for r in near.components(chain).collect()}
    assert set(labels.values()) == {0} and len(labels) == 1000
    assert written.count("links") == 1 and len(written) <= 15
    rng = random.Random(3)
    names = list(range(200))
    rng.shuffle(names)
    tangled = spark.createDataFrame(list(zip(names[:-1], names[1:], strict=True)), "a bigint, b bigint")
    assert {r.label for r in near.components(tangled).collect()} == {0}


def test_repeated_texts_are_verified_once(spark, monkeypatch):
    a, b = list(families(random.Random(4), 1, 1, (0,)))[0], None
    b = a + " end"
    rows = [(i % 2, (a, b)[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = []
    real = near.stored
    monkeypatch.setattr(near, "stored", lambda d, name="stored": sizes.append((name, out := real(d, name), out.count())) or out)
    found = near_classes(df).collect()
    assert {r.class_id for r in found} == {0} and sum(r.is_first for r in found) == 1
    assert {n for name, _, n in sizes if name == "bodies"} == {2}
    assert max(n for name, _, n in sizes if name == "edges") == 1


def test_clashing_columns_keep_their_values(spark):
    names = ["row", "copies", "_order", "_nth", "_tie0", "_tie", "_key", "_text", "_base", "label", "bucket", "given", "doc", "base", "terms", "a.b"]
    texts = [f"alpha beta gamma delta number {i} epsilon" for i in range(6)] + [None, ""]
    rows = [(i, t, *[f"{n}-{i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = first_of_classes(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == rows
    found = find_pii(df)
    assert found.columns == [*df.columns, "spans"]
    assert sorted(map(tuple, found.drop("spans").collect()), key=lambda r: r[0]) == rows
    mixed = mix_sources(df.withColumn("source", F.lit("s")))
    assert mixed.columns == [*df.columns, "source"]
    assert {tuple(r)[:-1] for r in mixed.collect()} <= set(rows) and mixed.count() > 0
    good = keep_good(df.withColumn("text", F.concat(F.lit("Words that stand here once: "), "text")))
    assert good.columns == df.columns
