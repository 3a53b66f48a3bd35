"""Operators that work text by text, the mix, and the pipeline."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from burstlens.llm import mixing
from burstlens.llm import queries as Q
from burstlens.llm.mixing import mix_sources, mixed_sizes
from burstlens.llm.pieces import MODEL, Lattice, Pieces, decode_pieces, encode, row_seeds, sample_pieces
from burstlens.llm.pii import find_pii, sanitise, span_digest
from burstlens.llm.quality import Bands, keep_good, quality_rules
from burstlens.llm.toxicity import fit_toxicity, marginals, score_toxicity

PROSE = "The quick brown fox saw twelve odd birds near a frozen lake while nobody else was looking at them today."


def frame(spark, texts, extra="src"):
    rows = [(i, t, f"{extra}{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_quality(spark):
    noise = "".join(chr(33 + (i * i * 7919 + i * 104729) % 90) for i in range(3000))
    texts = [PROSE, None, "", "too short", "spam ham " * 300, "one two three four five six seven eight nine ten eleven\n" * 3, noise]
    df = frame(spark, texts)
    found = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert [found[i]["kept"] for i in range(6)] == [True, False, False, False, False, False]
    assert found[5]["n_dup_lines"] == 2 and found[5]["n_repeat_words"] == 33
    assert found[0]["word_chars"] == len(PROSE.replace(" ", "")) and found[0]["n_symbols"] == 0
    kept = keep_good(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [0]
    assert quality_rules(df.limit(0)).count() == 0


def test_quality_query_on_the_whole_table(spark, sf_dir):
    """The base columns against a plain count, and limits without gaps at any size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in Q.QUERIES["op1_compression_bands"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        r = found[doc_id]
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == [
            len(words), sum(map(len, words)), symbols, again, len(inside), failed
        ]
        assert not (failed and r["kept"])
    bands = Bands()
    for size in range(1, 60_000, 7):
        low, high = bands.of(size)
        assert low < high and (size < 75) == (high == float("inf"))


def test_bands_lie_close_around_prose(spark, sf_dir):
    """What the base rule keeps and the bands reject: text without structure, and noisy prose."""
    rng = random.Random(4)

    def noise(letters, size):
        return " ".join("".join(rng.choices(letters, k=9)) for _ in range(size // 10 + 1))[:size]

    code = string.ascii_letters + string.digits + "+/"
    junk = [noise(code, n) for n in (150, 400, 1000, 1500, 2048, 5000, 50000)]
    junk += [noise(string.ascii_lowercase, n) for n in (800, 1500, 2048, 5000, 50000)]
    junk += [noise("0123456789abcdef", n) for n in (2048, 5000, 50000)]  # shorter hex shrinks just as prose
    junk += [" ".join(f"{w} {w}" for w in PROSE.split()[:n]) for n in (14, 20)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id")
    prose = [t for (t,) in docs.orderBy("doc_id").select("text").collect()]
    junk += ["\n".join(" | ".join(t.split()) + " |" for t in p.split("\n")) for p in prose if len(p) > 2500][:5]
    junk += [" ".join(f"{w}{rng.choice(['***', '%%%', '$$$'])}" for w in p.split()) for p in prose if len(p) > 800][:5]
    found = quality_rules(frame(spark, junk)).orderBy("doc_id").collect()
    assert [(i, r["reason"]) for i, r in enumerate(found) if r["kept"] or r["base_failed"]] == []
    rows = quality_rules(frame(spark, prose)).filter("not base_failed")
    assert rows.filter("kept").count() >= 0.97 * rows.count() > 20


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans_against_patterns(spark):
    texts = [
        "é mail a.b+c@x-y.example.com, or @x.y, a@b, u@v.w.", "at 10.0.0.255 not 10.0.0.256 but 1.2.3.4.5.6.7.8",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +49 (30) 1234-5678 now, +1 2, ++4912345678", None, "", "9" * 500 + "a@b.c" * 50,
    ]
    found = {r["doc_id"]: r for r in span_digest(find_pii(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        parts = []
        for kind, pattern in PATTERNS.items():
            spans = [m.span() for m in re.finditer(pattern, t or "") if valid(kind, m.group())]
            assert found[i][f"n_{kind}"] == len(spans), (i, kind)
            parts += [f"{kind}:{a}:{b}" for a, b in spans]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(parts).encode()).hexdigest()
        assert found[i]["spans"].startswith(",".join(parts))


def test_disclosing_terms(spark):
    texts = [f"write to Zaphod at z@b.org number {i}" for i in range(3)] + [f"{PROSE} number {i}" for i in range(60)]
    found = find_pii(frame(spark, texts)).withColumn("clean", sanitise(Q.F.col("text"), Q.F.col("spans")))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert {s["value"] for s in rows[0]["spans"] if s["kind"] == "term"} >= {"zaphod"}
    assert not any(s["value"] == "number" for s in rows[0]["spans"])
    assert "z@b.org" not in rows[0]["clean"] and "[EMAIL]" in rows[0]["clean"]
    assert rows[9]["clean"] == texts[9]
    assert find_pii(frame(spark, texts).limit(0)).count() == 0


EDGES = ".,;:!?()[]{}<>\"'`|*#%&$^~_=+-/\\@"


def plain_terms(rows, threshold=0.8, least=2):
    """The disclosing words of each row, by counting every pair of entity and term."""
    emails = [sorted(set(m.group() for m in re.finditer(PATTERNS["email"], t or ""))) for _, t in rows]
    terms = [{w.strip(EDGES).lower() for w in (t or "").split()} for _, t in rows]
    n_entity, n_term, both = Counter(), Counter(), Counter()
    for found, words in zip(emails, terms, strict=True):
        n_entity.update(found)
        n_term.update(words)
        both.update((e, w) for e in found for w in words)
    n, told = len(rows), set()
    for (e, w), k in both.items():
        content = np.log2(n / n_entity[e])
        if k >= least and content > 0 and np.log2(k * n / (n_entity[e] * n_term[w])) >= threshold * content - 1e-12:
            told.add((e, w))
    out = []
    for (_, t), found in zip(rows, emails, strict=True):
        base = [m.span() for m in re.finditer(PATTERNS["email"], t or "")]
        words = [(m.start(), m.end(), m.group().strip(EDGES).lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        out.append([
            x for x in words
            if re.search(r"[^\W\d_]", x[2]) and any((e, x[2]) in told for e in found)
            and not any(a < x[1] and x[0] < b for a, b in base)
        ])
    return out


def test_disclosing_terms_against_all_pairs(spark):
    """Far terms, entities that stand alone, short names, repeated rows, terms that stand elsewhere too."""
    rng = random.Random(11)
    common = [f"word{i}" for i in range(30)]
    people = [("a@b.org", "Zed"), ("c@d.net", "Yü"), ("e@f.com", "o"), ("g@h.io", "42"), ("solo@x.org", "Once")]
    rows = []
    for i in range(300):
        words = rng.choices(common, k=rng.randint(1, 120))
        mail, name = people[i % 4]
        if i % 3 == 0:
            words.insert(0, f"{name},")  # far from its entity
            words.append(f"<{mail}>" if i % 2 else mail)
        elif i % 7 == 0:
            words = [mail]
        elif i % 25 == 0:
            words.append(name)
        rows.append((i, " ".join(words)))
    rows += [(900, "solo@x.org Once only"), (901, "rare@y.org Twice told")] + [(901, "rare@y.org Twice told")]
    rows += [(902, None), (903, ""), (None, "a@b.org Zed"), (None, "a@b.org Zed")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id bigint, text string, terms string").repartition(6)
    found = Counter()
    for r in find_pii(df).collect():
        terms = tuple((s["start"], s["end"], s["value"]) for s in r["spans"] if s["kind"] == "term")
        found[r["doc_id"], r["text"], terms] += 1
    expected = Counter((*r, tuple(terms)) for r, terms in zip(rows, plain_terms(rows), strict=True))
    assert found == expected
    told = {t[2] for _, _, terms in expected for t in terms}
    assert "twice" in told and "yü" in told and "once" not in told and "42" not in told


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(n), f"s{i % 4}" if i % 9 else None) for i, n in enumerate(rng.geometric(0.02, 900))]
    rows += [(900, None, "s1"), (901, "", "s1"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixed_sizes(df).collect()
    assert len(found) == len(rows)
    totals = Counter()
    for r in found:
        totals[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    for r in found:
        assert abs(totals[r["source"]] - r["target"]) <= max(50, 0.01 * r["target"])
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    assert sum({r["source"]: r["target"] for r in found}.values()) == pytest.approx(sum(r["size"] for r in found))
    key = lambda r: (r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, mixed_sizes(df.repartition(7)).collect())) == sorted(map(key, found))
    mixed = mix_sources(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixed_sizes(df.limit(0)).count() == 0


def plain_targets(sizes):
    """Targets by giving out all words and taking back what is over three times a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_sources, rest = {}, set(order), sum(sizes.values())
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if rest * weight[s] / total >= 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_sources}
        target |= {s: 3 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        open_sources -= over
    return target


def test_mix_query_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    sizes, taken = Counter(), Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    target = plain_targets(sizes)
    found = Q.QUERIES["op5_pivotal_mix"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(size)
    for r in found:
        d = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[d], sizes[source[d]])
        assert r["target"] == pytest.approx(target[source[d]])
        assert r["taken"] == r["copies"] * size[d] <= 3 * size[d]
        taken[source[d]] += r["taken"]
    for s in sizes:  # ten documents of up to 2,933 words each
        assert abs(taken[s] - target[s]) <= 0.05 * target[s]


@pytest.mark.parametrize("hot_sources", [1, 1_000])
def test_targets_of_many_sources(spark, monkeypatch, hot_sources):
    """Geometric sizes cap sources turn by turn; few or all sources go to all tasks."""
    monkeypatch.setattr(mixing, "HOT_SOURCES", hot_sources)
    names = [None, "", "é", "z", "Z", "\U0001f600", "\uffff", *(f"s{i}" for i in range(20))]
    rows = [(i, "w " * (1 + 2 ** (i % 11)), s) for i, s in enumerate(names * 4)] + [(999, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = plain_targets(sizes)
    found = mixed_sizes(df).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]


def segmentations(text, vocab):
    """Every way to spell ``text`` in pieces, with its weight."""
    if not text:
        yield (), 1.0
    for i, piece in enumerate(vocab.pieces):
        if piece and text.startswith(piece) and np.isfinite(vocab.log_weight[i]):
            for rest, weight in segmentations(text[len(piece) :], vocab):
                yield (i, *rest), weight * np.exp(vocab.log_weight[i])


@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_piece_probabilities_by_enumeration(alpha):
    """Segmentations come as often as their share of the weight of all, and so do those of two words."""
    vocab = Pieces.load(MODEL, alpha)
    n = 20_000
    ways = {text: dict(segmentations(text, vocab)) for text in ("▁canal", "▁on")}
    ids, counts = encode(["canal on"] * n, row_seeds(list(range(n)), 0), Lattice(vocab))
    ends = np.cumsum(counts)
    drawn = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True))
    chance = {
        a + b: v * w / sum(ways["▁canal"].values()) / sum(ways["▁on"].values())
        for a, v in ways["▁canal"].items()
        for b, w in ways["▁on"].items()
    }
    assert set(drawn) <= set(chance) and len(chance) > 20
    for way, p in chance.items():
        assert abs(drawn[way] - n * p) <= 5 * np.sqrt(n * p * (1 - p)) + 3


def test_pieces_are_lossless_and_repeatable(spark):
    texts = [PROSE, "", None, "  two  spaces ▁ mark ", "naïve 漢字 🙂\n\ttabs", PROSE * 40]
    df = frame(spark, texts)
    found = sample_pieces(df).collect()
    assert all(r["lossless"] for r in found)
    back = {r["doc_id"]: r["text"] for r in decode_pieces(sample_pieces(df)).collect()}
    assert [back[i] for i in range(6)] == texts
    again = {r["doc_id"]: r["ids"] for r in sample_pieces(df.repartition(3)).collect()}
    assert all(again[r["doc_id"]] == r["ids"] for r in found)
    other = {r["doc_id"]: r["ids"] for r in sample_pieces(df, seed=1, model=MODEL).collect()}
    assert other[5] != again[5]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    emission, moves = rng.standard_normal(7), rng.standard_normal((2, 2))
    total, ones = 0.0, np.zeros(7)
    for m in range(128):
        y = [(m >> i) & 1 for i in range(7)]
        w = np.exp(sum(e * v for e, v in zip(emission, y, strict=True)) + sum(moves[a, b] for a, b in zip([0, *y], y, strict=False)))
        total += w
        ones += w * np.array(y)
    assert marginals(emission, np.array([7]), moves) == pytest.approx(ones / total)


def test_toxicity_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir[:-5]}0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.QUERIES["op2_toxic_spans"](spark, f"{sf_dir[:-5]}0.1").join(labels, "doc_id").filter("held_out and toxic is not null")
    rows = [(r["score"], r["toxic"]) for r in scored.collect()]
    order = sorted(rows)
    rank = {id(r): i for i, r in enumerate(order)}
    pos = [rank[id(r)] for r in order if r[1] == 1]
    auc = (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(rows) - len(pos)))
    assert auc > 0.9
    model = fit_toxicity(docs.limit(0), labels.limit(0))
    odd = score_toxicity(frame(spark, [None, ""]), model).collect()
    assert all(0 <= r["score"] <= 1 and r["spans"] == [] for r in odd)


def test_chat_round_trip(spark, sf_dir):
    found = {r["conv_id"]: r for r in Q.QUERIES["op9_budgeted_windows"](spark, sf_dir).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", Q.CONTROL_STRINGS), ("assistant", Q.CONTROL_STRINGS)]
    assert found.keys() == turns.keys()
    for conv, own in turns.items():
        said = "".join(f"{role}\n{text}\n" for role, text in own)
        loss = "".join(text for role, text in own if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns and docs.count() > 0, name
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert final.count() == docs.count() and final.filter("not lossless").count() == 0
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["n_ids"]) for r in again.collect()) == sorted((r["doc_id"], r["n_ids"]) for r in final.collect())


def test_texts_without_an_entity_are_not_shuffled(spark):
    texts = [(i, f"mail kim{i}@lake.org about otters" if i < 3 else f"plain text {i}") for i in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = find_pii(docs)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    joined = [plan.children().apply(i).toString() for i in range(2)]
    assert ["Join LeftOuter" in side for side in joined] == [False, True]
    sizes = {r.doc_id: len(r.spans) for r in found.collect()}
    assert all((sizes[i] > 0) == (i < 3) for i in range(9))
