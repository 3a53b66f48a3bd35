"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from document labels: in toxic documents, tokens with a feature (the word
or one of its prefixes) that toxic documents have far more often count as toxic. The field has
two states, weights for these features and for the four transitions, and is trained by full
likelihood on a bounded sample. Forward-backward marginals give each token's probability; they
sum up to a document score, and runs of likely tokens are the offending spans.

With two states, the forward message is one number (the odds) and a stretch of text is a
2x2 matrix, so long texts are cut into blocks that numpy handles side by side.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.llm.common import map_texts

SAMPLE_DOCS = 1_500  # labelled documents of either class that training sees at most
SAMPLE_BYTES = 16_384  # longer ones are left out of the sample; scoring takes whole texts
PREFIXES = (3, 4, 5, 6, 7)
BLOCK = 256
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WHOLE = "="  # marks a feature that is a whole word


def tokens(text: str | None) -> list[str]:
    return [w.decode().strip(EDGES).lower() for w in (text or "").encode().split()]


def features(token: str) -> list[str]:
    return [_WHOLE + token, *(token[:n] for n in PREFIXES if len(token) > n)] if token else []


@dataclass
class Field:
    """A trained field: emission weights, transitions and the calibration of document scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -10.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0, 0, 0]))

    def emission(self, token: str) -> float:
        known = self.weights
        return self.bias + sum(known.get(f, 0.0) for f in features(token))


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and document of each block of the tokens laid end to end."""
    count = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(lengths) - lengths, count) + nth * BLOCK
    return start, np.minimum(BLOCK, lengths[doc] - nth * BLOCK), doc


def forward_backward(
    emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state 1 at each token from the left, from the right, and from the left just before.

    ``emission`` has the weight of state 1 against 0 for the tokens of all documents end to end.
    A document starts after a token of state 0.
    """
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(moves)
    left, right, ahead = np.zeros(len(e)), np.ones(len(e)), np.zeros(len(e))
    if not len(e):
        return left, right, ahead
    start, size, doc = _blocks(lengths)
    order = np.argsort(-size, kind="stable")
    s_start, s_size = start[order], size[order]
    active = np.searchsorted(-s_size, -np.arange(BLOCK), side="left")  # blocks longer than t
    # Product of a block's step matrices; [i, j] leads from state i before it to j at its end.
    p = np.tile(np.array([1.0, 0.0, 0.0, 1.0])[:, None], (1, len(order)))
    for t in range(int(s_size[0])):
        k = active[t]
        x = e[s_start[:k] + t]
        a, b, c, d = p[:, :k]
        top0, top1 = a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * x
        low0, low1 = c * m[0, 0] + d * m[1, 0], (c * m[0, 1] + d * m[1, 1]) * x
        p[:, :k] = np.stack([top0, top1, low0, low1]) / (top0 + top1 + low0 + low1)
    product = np.empty_like(p)
    product[:, order] = p
    # Odds at the borders of the blocks, one block of every document after the other.
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(first, append=len(doc))
    enter, leave = np.zeros(len(doc)), np.ones(len(doc))
    for n in range(int(count.max()) - 1):
        at = first[count > n + 1] + n
        a, b, c, d = product[:, at]
        enter[at + 1] = (b + d * enter[at]) / (a + c * enter[at])
    last = first + count - 1
    for n in range(int(count.max()) - 1):
        at = last[count > n + 1] - n
        a, b, c, d = product[:, at]
        leave[at - 1] = (c + d * leave[at]) / (a + b * leave[at])
    r = enter[order].copy()
    for t in range(int(s_size[0])):
        k = active[t]
        at = s_start[:k] + t
        ahead[at] = r[:k]
        r[:k] = e[at] * (m[0, 1] + m[1, 1] * r[:k]) / (m[0, 0] + m[1, 0] * r[:k])
        left[at] = r[:k]
    f = leave[order].copy()
    for t in range(int(s_size[0]) - 1, -1, -1):
        k = active[t]
        at = s_start[:k] + t
        right[at] = f[:k]
        x = e[at] * f[:k]
        f[:k] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    return left, right, ahead


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    left, right, _ = forward_backward(emission, lengths, moves)
    odds = left * right
    return odds / (1 + odds)


def _choose_features(texts: list[list[str]], toxic: np.ndarray) -> tuple[dict, set]:
    """Features worth a weight, and those that mark a token of a toxic document as toxic."""
    seen = (Counter(), Counter())
    for words, y in zip(texts, toxic, strict=True):
        seen[int(y)].update({f for w in set(words) for f in features(w)})
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    least = max(3, round(0.004 * n1))
    odds = {
        f: math.log((n + 0.5) / (n1 + 1)) - math.log((seen[0][f] + 0.5) / (n0 + 1))
        for f, n in seen[1].items()
        if n >= least
    }
    marking = {f for f, v in odds.items() if v >= 2.5}
    useful = [f for f, v in odds.items() if abs(v) >= 0.7]
    return {f: i for i, f in enumerate(sorted(useful))}, marking


def train_field(texts: list, toxic: list, prior: float, rounds: int = 80) -> Field:
    """Fits a field to sampled texts; ``prior`` is the share of toxic documents at large.

    Without documents of both classes nothing can be learnt: all scores then equal the prior.
    """
    base = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    y_doc = np.array(toxic, bool)
    if not y_doc.any() or y_doc.all():
        return Field(calibration=np.array([base, 0, 0, 0]))
    docs = [tokens(t) for t in texts]
    index, marking = _choose_features(docs, y_doc)
    lengths = np.array([len(d) for d in docs], np.int64)
    token, feature, y = [], [], np.zeros(int(lengths.sum()))
    made: dict[str, tuple[list, bool]] = {}
    at = 0
    for words, bad in zip(docs, y_doc, strict=True):
        for w in words:
            if w not in made:
                own = features(w)
                made[w] = ([index[f] for f in own if f in index], any(f in marking for f in own))
            ids, marked = made[w]
            if ids:
                feature += ids
                token += [at] * len(ids)
            y[at] = bad and marked
            at += 1
    token, feature = np.array(token, np.int64), np.array(feature, np.int64)
    y_before = np.concatenate([[0.0], y[:-1]])
    y_before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0.0
    w = np.zeros(len(index))
    bias, moves = -4.0, np.zeros((2, 2))
    theta = np.concatenate([w, [bias], np.zeros(3)])
    step, drift = np.zeros_like(theta), np.zeros_like(theta)
    for n in range(1, rounds + 1):
        w, bias = theta[: len(index)], theta[len(index)]
        moves = np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
        emission = bias + np.bincount(token, weights=w[feature], minlength=len(y))
        left, right, ahead = forward_backward(emission, lengths, moves)
        p = left * right / (1 + left * right)
        x = np.exp(np.clip(emission, -30, 30)) * right
        m = np.exp(moves)
        pairs = np.stack([np.full_like(x, m[0, 0]), m[0, 1] * x, ahead * m[1, 0], ahead * m[1, 1] * x])
        pairs /= pairs.sum(axis=0)
        gap = y - p
        grad = np.concatenate(
            [
                np.bincount(feature, weights=gap[token], minlength=len(index)),
                [gap.sum()],
                [
                    ((1 - y_before) * y - pairs[1]).sum(),
                    (y_before * (1 - y) - pairs[2]).sum(),
                    (y_before * y - pairs[3]).sum(),
                ],
            ]
        )
        grad = grad / len(docs) - 2e-4 * np.concatenate([w, np.zeros(4)])
        step = 0.9 * step + 0.1 * grad
        drift = 0.99 * drift + 0.01 * grad**2
        theta = theta + 0.3 * (step / (1 - 0.9**n)) / (np.sqrt(drift / (1 - 0.99**n)) + 1e-8)
    out = Field(
        {f: float(theta[i]) for f, i in index.items()},
        float(theta[len(index)]),
        np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]),
    )
    _, measures = _measure(out, docs)
    share = np.where(y_doc, prior / y_doc.mean(), (1 - prior) / (1 - y_doc.mean()))
    out.calibration = _logistic(measures, y_doc.astype(float), share)
    return out


def _measure(model: Field, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token marginals, and per document the columns of the calibration."""
    lengths = np.array([len(d) for d in docs], np.int64)
    cache: dict[str, float] = {}
    emission = np.empty(int(lengths.sum()))
    at = 0
    for words in docs:
        for w in words:
            e = cache.get(w)
            if e is None:
                e = cache[w] = model.emission(w)
            emission[at] = e
            at += 1
    p = marginals(emission, lengths, model.moves)
    doc = np.repeat(np.arange(len(docs)), lengths)
    expected = np.bincount(doc, weights=p, minlength=len(docs))
    most = np.zeros(len(docs))
    np.maximum.at(most, doc, p)
    columns = np.stack(
        [np.ones(len(docs)), np.log(expected + 1e-3), most, np.log1p(lengths)], axis=1
    )
    return p, columns


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small penalty."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - beta)
    return beta


def held_out(key: str):
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_docs: int = SAMPLE_DOCS,
) -> Field:
    """A field trained on at most ``sample_docs`` labelled documents of either class.

    Held-out rows and null labels are left out and repeated label rows count once; the sample
    goes by a hash of the key, then of the text, and only it reaches the driver.
    """
    usable = (
        labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_k").isNotNull() & F.col("_y").isin(0, 1))
        .filter(~held_out("_k"))
        .dropDuplicates()
    )
    totals = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    order = [F.xxhash64("_k"), F.col("_k")]
    chosen = None
    for y in (0, 1):
        part = usable.filter(F.col("_y") == y).orderBy(*order).limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = (
        docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
        .filter(F.octet_length("_t") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen), "_k")  # at most 2 * sample_docs rows of two numbers
        .orderBy("_k", F.xxhash64("_t"), "_t", "_y")
        .limit(2 * sample_docs)
        .collect()
    )
    prior = n1 / (n1 + n0) if n1 + n0 else 0.0
    return train_field([r["_t"] for r in sample], [r["_y"] for r in sample], prior)


def score_toxicity(
    docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text", likely: float = 0.5
) -> DataFrame:
    """``key``, ``score``, ``predicted`` and ``spans`` (start, end, probability) of every row.

    Spans are runs of tokens with a marginal of at least ``likely``, in code points, end
    exclusive. Null and empty texts have no tokens and no spans; their score follows from that.
    Whole texts are scored; equal texts get equal scores; other columns are not looked at.
    """
    span = T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("p", T.DoubleType()),
        ]
    )
    fields = [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("spans", T.ArrayType(span)),
    ]

    def work(texts: list) -> list:
        words = [tokens(t) for t in texts]
        p, measures = _measure(model, words)
        logit = np.clip(measures @ model.calibration, -30, 30)
        score = 1 / (1 + np.exp(-logit))
        ends = np.cumsum([len(w) for w in words])
        spans = [[] for _ in texts]
        hot = np.flatnonzero(p >= likely)
        owner = np.searchsorted(ends, hot, side="right")
        for i in np.unique(owner):
            first = ends[i] - len(words[i])
            own = hot[owner == i]
            spans[i] = _runs(texts[i], own - first, p[own])
        return [score, (score >= 0.5).astype(np.int32), spans]

    return map_texts(docs, key, text, fields, work)


def _runs(text: str, numbers: np.ndarray, p: np.ndarray) -> list[dict]:
    """Spans of the runs of token numbers."""
    places, at = [], 0
    for word in text.encode().split():  # find each word in the text, left to right
        word = word.decode()
        at = text.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    found = []
    for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers) > 1) + 1):
        start, end = places[numbers[part[0]]][0], places[numbers[part[-1]]][1]
        found.append({"start": start, "end": end, "p": float(p[part].max())})
    return found
