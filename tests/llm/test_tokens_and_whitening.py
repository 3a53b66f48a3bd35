"""Exact whitening, token tables and cross-tokenizer alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burstlens.llm import alignment as AL
from burstlens.llm import characteristic as ch
from burstlens.llm import queries as Q
from burstlens.llm import token_memo as TM
from burstlens.llm import token_table as TT
from burstlens.llm import whitening as W

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\x1ca b", "a　b", "x y", "don't 's", "<|endoftext|>",
    "a <|endoftext|> b", "</s> <s>", "<0x41>", "日本 語", "😀 é", "▁", "a ▁b", "a\x00b", "1 22 333", "\r\n", "a  b",
    "😀" * 40, "ab" * 9000, "word " * 3000,
]


# --- op11 ---------------------------------------------------------------------------------
def polynomial_by_traces(m):
    """Faddeev and Le Verrier's recursion in fractions, the constant first."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        trace = sum(sum(m[i][t] * b[t][i] for t in range(d)) for i in range(d))
        c.append(-trace / k)
    return [int(v) for v in c[::-1]]


def scatter_of(rows):
    n, s = len(rows), rows.sum(axis=0)
    return [[int(v) for v in r] for r in n * (rows.T @ rows) - np.outer(s, s)]


def solve(m):
    poly = ch.combine({p: ch.char_residues(m, p).tolist() for p in ch.primes_needed(m)})
    found = ch.isolate(poly, len(m))
    return poly, [(*ch.refine(poly, *i), i[3]) for i in found]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial_and_roots(d):
    rows = np.random.default_rng(d).integers(-30, 30, (3 * d + 1, d))
    if d == 7:
        rows[:, 3], rows[:, 5] = rows[:, 2], 4  # two directions without variance
    m = scatter_of(rows)
    poly, roots = solve(m)
    assert poly == polynomial_by_traces(m)
    values = sorted(np.linalg.eigvalsh(np.array(m, float)))[::-1]
    assert len(roots) == d - 2 * (d == 7) and all(r[2] == 1 for r in roots)
    for (a, k, _), expected in zip(roots, values, strict=False):
        assert a / (1 << k) == pytest.approx(expected, rel=1e-9)
        (v,) = ch.null_vectors(m, a, k, 1)
        assert np.abs(np.array(m, float) @ v - a / (1 << k) * np.array(v)).max() <= 1e-13 * values[0]


def test_multiple_and_close_roots():
    assert [r[2] for r in solve([[3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]])[1]] == [1, 2]
    vectors = np.array(ch.null_vectors([[3, 0], [0, 3]], 3, 0, 2))
    assert np.allclose(vectors @ vectors.T, np.eye(2), atol=1e-15)
    big = 10**30  # a difference that doubles cannot see
    _, roots = solve([[big, 0], [0, big + 1]])
    assert [(a >> k, m) for a, k, m in roots] == [(big + 1, 1), (big, 1)]
    assert solve([[0, 0], [0, 0]])[1] == []


def whitening_by_numpy(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, axes = values[order], axes[:, order]
    deviation = ((n * x - fit.sum(axis=0)).astype(object) ** 2).sum(axis=1)
    return n, deviation, (x - mean) @ axes / np.sqrt(values), values / values.sum()


def test_whitening_against_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    n, deviation, white, explained = whitening_by_numpy([r.embedding for r in rows])
    found = Q.QUERIES["op11_exact_whitening"](spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["n"] == "bigint"
    at = {r.vec_id: i for i, r in enumerate(rows)}
    whole = found.collect()
    assert len(whole) == 16 * len(rows)
    ours = np.zeros((len(rows), 16))
    for r in whole:
        i, c = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == deviation[i]
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9
        ours[i, c] = r.whitened
    for c in range(16):
        sign = np.sign(ours[0, c] * white[0, c])
        assert np.allclose(ours[:, c], sign * white[:, c], atol=1e-8)


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    rows = [*good, *good[:5], (None, good[0][1]), *bad]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, component string, x double")
    found = W.whiten(df).collect()
    assert len(found) == 36 * 3 and {r.n for r in found} == {30}
    assert sum(r.vec_id is None for r in found) == 3 and {r.component for r in found} == {1, 2, 3}
    by = Counter((r.vec_id, r.component) for r in found)
    assert by[0, 1] == 2 and by[20, 1] == 1
    assert sum({r.component: r.explained for r in found}.values()) == pytest.approx(1.0)
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.filter("vec_id = 0")).count() == 0  # one distinct vector
    wide = df.filter("vec_id < 20").withColumn("embedding", F.transform("embedding", lambda e: e * 1e15))
    huge = W.whiten(wide).collect()  # sums beyond 64 bits
    assert len(huge) == 25 * 3 and all(r.identity_error < 1e-9 for r in huge)
    assert all(r.deviation is not None and r.deviation > 2**63 for r in huge)


# --- op12 ---------------------------------------------------------------------------------
def frame(spark, texts, **extra):
    kinds = "doc_id bigint, text string" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([(i, t, *extra.values()) for i, t in enumerate(texts)], kinds)


def plain_ids(texts):
    model = Tokenizer.from_file(TM.vocabulary_path(TT.VOCABULARY))
    return [[*model.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def digest_of(all_ids):
    out, start = [], 0
    for ids in all_ids:
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    found = {r.doc_id: r[1:] for r in Q.QUERIES["op12_token_table"](spark, sf_dir).collect()}
    expected = digest_of(plain_ids([r.text for r in docs]))
    assert [tuple(found[r.doc_id]) for r in docs] == expected and len(found) == len(docs)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table_files(spark, tmp_path, encoding, monkeypatch):
    monkeypatch.setattr(TT, "PART_IDS", 1000)  # long documents become several rows
    texts = [*ODD, None] * 3 + [f"some words here number {i} " * 40 for i in range(300)]
    path = str(tmp_path / "table")
    docs = frame(spark, texts, shard="s", ids="i", key="k", part="p")
    TT.write_token_table(docs, path, shards=4, encoding=encoding, row_group_bytes=4_000, page_bytes=1_000)
    expected = plain_ids(texts)
    found = {r.doc_id: r[1:] for r in TT.token_digest(spark, path).collect()}
    assert [tuple(found[i]) for i in range(len(texts))] == digest_of(expected)
    whole = [t for ids in expected for t in ids]
    for lo, hi in ((0, 5), (17, 18), (990, 4321), (0, len(whole)), (len(whole) - 3, len(whole) + 9)):
        rows = TT.read_span(spark, path, lo, hi).orderBy("start").collect()
        assert [t for r in rows for t in r.ids] == whole[lo:hi] and rows[0].start == lo
    n_groups = 0
    for file in (tmp_path / "table/tokens").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        n_groups = max(n_groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = columns[TT.IDS]
            wanted = "RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED"
            assert wanted in ids.encodings and ids.has_column_index and ids.has_offset_index
            assert "DELTA_BINARY_PACKED" in columns["offset"].encodings
    assert n_groups > 1
    narrow = TT.read_token_table(spark, path).filter("doc_id = 7").select("doc_id", "start")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0] and "EqualTo(doc_id,7)" in plan


def test_token_table_edge_cases(spark, tmp_path):
    rows = [(2, "b"), (None, "n"), (1, None), (2, "b"), (2, "a"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    TT.write_token_table(docs, str(tmp_path / "a"), shards=3)
    found = TT.token_digest(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [0, 1, 2, 2, 2, None] and [r.n_tokens for r in found] == [1, 1, 2, 2, 2, 2]
    assert [r.start for r in found] == [0, 1, 2, 4, 6, 8]
    TT.write_token_table(docs.limit(0), str(tmp_path / "b"))
    assert TT.token_digest(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError, match="dictionary or delta"):
        TT.write_token_table(docs, str(tmp_path / "c"), encoding="plain")


def test_checksums_join():
    rng = random.Random(5)
    for a, b in ((0, 0), (0, 9), (9, 0), (1, 1), (1000, 70001)):
        x, y = rng.randbytes(a), rng.randbytes(b)
        assert TT.crc_join(zlib.crc32(x), zlib.crc32(y), b) == zlib.crc32(x + y)


def test_memo_gives_the_ids_of_whole_texts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "日本", "42", "!?", "<|endoftext|>", " ", " ", "\x1c", "　", "</s>", '"', "don't"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)] + ODD
    whole = Tokenizer.from_file(TM.vocabulary_path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=TM.vocabulary_path("piece_bpe_32k.model"))
    monkeypatch.setattr(TM.Memo, "KEEP", 50)  # forget often

    def split(memo, lead):
        out = []
        for lo in range(0, len(texts), 100):
            ids, counts = memo.encode(pa.array(texts[lo : lo + 100]), lead)
            out += [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
        return out

    expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert split(TM.byte_level.__wrapped__("byte_bpe_50k.json"), False) == expected
    found = split(TM.piece_level.__wrapped__("piece_bpe_32k.model"), True)
    for text, ids in zip(texts, found, strict=True):
        if TM.MARK not in text:  # such texts spell spaces that are none, and align to nothing
            assert ids == pieces.encode(text), repr(text)


# --- op13 ---------------------------------------------------------------------------------
def plain_alignment(texts):
    """Every pair of tokens compared, on whole texts."""
    model = Tokenizer.from_file(TM.vocabulary_path(AL.VOCABULARY_A))
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=TM.vocabulary_path(AL.VOCABULARY_B))
    spell_a = TM.token_bytes(AL.VOCABULARY_A)
    docs, counts = [], Counter()
    for text in texts:
        tokens = []
        if text:
            a = model.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            raw_a = [spell_a[i] for i in a]
            raw_b = [
                bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, pieces.id_to_piece(i)) for i in b)
            ]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                for ids, raws in ((a, raw_a), (b, raw_b)):
                    ends = np.cumsum([len(r) for r in raws]).tolist()
                    tokens.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
        links = [(x[0], y[0]) for x in tokens[0] for y in tokens[1] if x[1] < y[2] and y[1] < x[2]] if tokens else []
        docs.append((tokens, links))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for tokens, links in docs:
        groups = []
        if tokens:
            cuts = sorted({t[2] for t in tokens[0]} & {t[2] for t in tokens[1]})
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
                sides = [",".join(str(t[0]) for t in side if lo <= t[1] < hi) for side in tokens]
                groups.append("|".join(sides))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if tokens else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        sizes = [len(t) for t in tokens] or [0, 0]
        out.append((*sizes, len(groups), len(links), digest, best, sum(counts[p] for p in links)))
    return out


@pytest.mark.parametrize("broadcast_pairs", [0, 10_000_000])
def test_alignment_against_all_pairs(spark, broadcast_pairs):
    rng = random.Random(2)
    words = ["straße", "naïve", "tokenization", "日本語", "foo", "x1y2", "…", "don't", "antidisestablish", "😀", "a\nb", "  "]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [t for t in ODD if len(t) < 500] + [None] + texts[:3]
    docs = frame(spark, texts, row="r", pairs="p", n_a="n").repartition(5)
    found = AL.cross_align(docs, broadcast_pairs=broadcast_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    ours = {r.doc_id: tuple(r[1:]) for r in found.collect()}
    assert [ours[i] for i in range(len(texts))] == plain_alignment(texts)
    assert ours[texts.index("▁")][:2] == (0, 0) and sum(o[4] == "" for o in ours.values()) >= 3


def test_alignment_query_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.length("text")).select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text) < 2500]
    ours = {r.doc_id: r for r in Q.QUERIES["op13_cross_alignment"](spark, sf_dir).collect()}
    assert len(ours) == len(docs) and len(short) > 50
    for r, plain in zip(short, plain_alignment([r.text for r in short]), strict=True):
        assert tuple(ours[r.doc_id])[1:6] == plain[:5]


def test_alignment_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    found = AL.cross_align(docs)
    assert {tuple(r)[1:] for r in found.collect()} == {tuple(found.first())[1:]} and found.count() == 3
    assert found.first().count_sum == 3 * found.first().n_links
    assert AL.cross_align(docs.limit(0)).count() == 0
    groups = AL.align(docs, keep_groups=True).first()
    assert hashlib.sha256(groups.groups.encode()).hexdigest() == groups.groups_sha256
