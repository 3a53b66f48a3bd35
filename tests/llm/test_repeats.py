"""Substring operators against a scan of every window."""

import hashlib
import random

import numpy as np
import pytest

from burstlens.llm import fm_index, repeats, suffix_merge
from burstlens.llm.fm_index import dedup_substrings
from burstlens.llm.suffix_merge import dedup_suffixes, merge_shards, rotations


def brute(docs, width, cut, join):
    """doc order -> (units, removed, hash of the rest)."""
    seen, out = set(), []
    for key, text in docs:
        units = cut(text or "")
        gone = [False] * len(units)
        for i in range(len(units) - width + 1):
            window = join(units[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = join([u for u, g in zip(units, gone, strict=True) if not g])
        out.append((key, len(units), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def sample_docs():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = prose(60)
    docs = [f"{prose(rng.randint(5, 80))} {shared} {prose(10)}" for _ in range(20)]
    docs += [docs[0], docs[0][:-40] + "other end", "", None, "x" * 400, "ab " * 200, prose(3000)]
    docs += [" ".join([shared] * 3), docs[3][50:350], shared]
    return list(enumerate(docs))


def run(spark, docs, operator, size):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, row string").repartition(5)
    rows = operator(df).select("doc_id", size, "n_removed", "kept_sha256").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("hot", [1_000, 2])
def test_bytes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = sample_docs()
    found = run(spark, [(*d, "clash") for d in docs], dedup_suffixes, "n_bytes")
    assert found == brute(docs, 100, lambda t: list(t.encode()), bytes)


def test_words_against_brute_force(spark):
    docs = sample_docs()
    found = run(spark, [(*d, "clash") for d in docs], dedup_substrings, "n_words")
    assert found == brute(docs, 20, lambda t: t.encode().split(), b" ".join)


@pytest.mark.parametrize(("operator", "size"), [(dedup_suffixes, "n_bytes"), (dedup_substrings, "n_words")])
def test_null_keys_repeated_rows_and_empty_tables(spark, operator, size):
    text = " ".join(f"word{i}" for i in range(60))
    docs = [(None, text, "a"), (7, text, "b"), (7, text, "b"), (8, None, "c"), (None, None, None)]
    found = run(spark, docs, operator, size)
    assert len(found) == 5
    assert sorted(r[2] == 0 for r in found if r[1]) == [False, False, True]
    assert next(r for r in found if r[1] and r[2] == 0)[0] is None  # a null key is the smallest
    assert run(spark, [], operator, size) == []


def test_merge_gives_sorted_prefixes_and_common_bytes():
    rng = np.random.default_rng(3)
    shards = [np.append(rng.integers(97, 99, n).astype(np.uint8), [0xFE, 0xFF]).astype(np.uint8) for n in (90, 70, 50)]
    orders, place, block, common = merge_shards(shards, 20)
    merged = [None] * len(place)
    at = 0
    for text, order in zip(shards, orders, strict=True):
        ring = np.concatenate([text] * 3)
        assert [bytes(np.roll(text, -p)) for p in order] == sorted(bytes(np.roll(text, -p)) for p in order)
        for p in order:
            merged[place[at]] = bytes(ring[p : p + 20])
            at += 1
    assert merged == sorted(merged)
    for i in range(1, len(merged)):
        assert (block[i] == block[i - 1]) == (merged[i] == merged[i - 1])
        shared = next((k for k in range(20) if merged[i][k] != merged[i - 1][k]), 20)
        assert common[i] == (-1 if shared == 20 else shared // 10 * 10)


def test_wavelet_ranks_and_statistics():
    rng = np.random.default_rng(4)
    symbols = np.append(rng.integers(0, 9, 400), 9)
    tree = fm_index.WaveletTree(symbols, 10)
    at = rng.integers(0, 402, 200)
    c = rng.integers(0, 10, 200)
    assert tree.rank(c, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(c, at, strict=True)]
    index = fm_index.FMIndex(symbols, 10)
    last = np.arange(6, 400)
    reached, lo, hi = index.search(symbols, last, 5)
    text = symbols.tolist()
    for e, r, n in zip(last.tolist(), reached, hi - lo, strict=True):
        count = lambda k: sum(text[i : i + k] == text[e - k + 1 : e + 1] for i in range(len(text) - k + 1))  # noqa: B023,E731
        best = max(k for k in range(1, 6) if k == 1 or count(k) > 1)
        assert r == best
        if r == 5:
            assert n == count(5)


def test_rotations_of_bytes_and_words():
    text = np.frombuffer(b"bananabanana\xff", np.uint8)
    for symbols in (text, text.astype(np.int64)):
        order = rotations(symbols)
        turned = [bytes(np.roll(text, -p)) for p in order]
        assert turned == sorted(turned)
    assert suffix_merge.WIDTH % suffix_merge.STEP == 0


@pytest.mark.parametrize("hot", [1_000, 3])
def test_hot_anchors_are_split_not_exploded(spark, monkeypatch, hot):
    """op6: hot anchors were exploded into windows that met in a join."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choices("abcdefghij", k=n))
    for size in (40, 70, 95, 99, 100, 130):
        line = letters(size)
        near = [letters(30) for _ in range(3)]
        docs = [(i, f"{letters(80)}{rng.choice(near)}{line}{rng.choice(near)}{letters(60)}") for i in range(60)]
        docs += [(60, line * 5), (61, docs[4][1][20:]), (62, docs[9][1][:-30] + letters(200))]
        found = run(spark, [(*d, "clash") for d in docs], dedup_suffixes, "n_bytes")
        assert found == brute(docs, 100, lambda t: list(t.encode()), bytes)
        spaced = [(k, " ".join(t)) for k, t in docs]
        found = run(spark, [(*d, "clash") for d in spaced], dedup_substrings, "n_words")
        assert found == brute(spaced, 20, lambda t: t.encode().split(), b" ".join)
    plan = dedup_suffixes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_halves_keep_every_window():
    """op6: each window of a context stays in one part, and each part's anchor in all its windows."""
    rng = np.random.default_rng(1)
    for width, core in ((100, 32), (100, 99), (20, 8), (20, 19)):
        pos = rng.integers(0, width - core + 1, 200)
        windows = np.array([rng.integers(1, p + 1 + 1) if p else 1 for p in pos])
        index, first, n, at, long = repeats.halves(windows, pos, np.full(200, core), width)
        assert (long > core).all() and (long <= width).all()
        covered = [[] for _ in pos]
        for i, f, k, a, c in zip(index, first, n, at, long, strict=True):
            covered[i] += range(f, f + k)
            assert a - (k - 1) >= 0 and a + c <= width  # inside the last and the first window
        assert [sorted(c) for c in covered] == [list(range(w)) for w in windows]
