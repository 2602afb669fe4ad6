"""Operator 10, quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; the unlabelled sample is
web text as it comes. The class prior of the unlabelled text is estimated
from how the two samples' score tails compare, and a logistic model minimises
the non-negative unbiased risk: the positives' risk, weighted by the prior,
plus the negative risk of the unlabelled text less what the positives hidden
in it account for, never taken below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, packed, quoted, ready, row_ddl, slices, texts, unpacked
from quire.llm.labelled import keyed, learnable, sample_texts

#: Bounds of the samples: different texts of each kind, and their bytes.
POSITIVE_ROWS, UNLABELLED_ROWS, SAMPLE_BYTES = 3000, 6000, 8 << 20
THRESHOLD = 0.3
RESULTS = ["held_out", "score", "predicted"]

#: Character classes: lower and other letters, capitals, digits, white space;
#: all other ASCII characters are classes of their own.
CLASSES = bytes(ord("a") if 97 <= b <= 122 or b > 127 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57
                else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
BUCKETS = 128


def features(text: bytes) -> np.ndarray:
    """Shares of character classes and of their hashed pairs, and measures of
    words and lines. The text is read whole."""
    words = text.split()
    n = max(len(words), 1)
    size = max(len(text), 1)
    coarse = text.translate(CLASSES)
    kinds = np.frombuffer(coarse, np.uint8)
    share = np.bincount(kinds, minlength=128)[:128] / size
    pairs = np.bincount((kinds[:-1].astype(np.int64) * 131 + kinds[1:] * 7) % BUCKETS, minlength=BUCKETS) / size \
        if size > 1 and len(kinds) > 1 else np.zeros(BUCKETS)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    same = [a == b for a, b in zip(words, words[1:])]
    twice = sum(same) / n
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    measures = [np.log1p(n) / 10, lengths.mean() / 10, lengths.std() / 10, twice, len(set(words)) / n,
                len(set(lines)) / len(lines), np.log1p(size / len(lines)) / 10,
                sum(b"a" not in w for w in coarse.split()) / n, np.sqrt(twice), float(twice > 0.2),
                (len(set(words)) / n) ** 2,
                sum(w[-1:] in b".!?" for w in words) / n, sum(len(w) == 1 for w in words) / n, float(not words)]
    return np.concatenate([np.sqrt(share), np.sqrt(pairs), measures])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, gradient_of, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam on a linear model."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = gradient_of(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1e-3) -> float:
    """The share of positives in the unlabelled sample.

    A model that tells the samples apart is trained on one half of each. On
    the other half, at any score, the unlabelled rows above it hold at least
    prior x (positives above it); the least such ratio over scores that keep
    enough positives estimates the prior from above."""
    halves = [(a[0::2], a[1::2]) for a in (positive, unlabelled)]
    x = np.vstack([h[0] for h in halves])
    y = np.concatenate([np.ones(len(halves[0][0])), np.zeros(len(halves[1][0]))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = _descend(x, lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + ridge * w, 300)
    own, web = np.sort(halves[0][1] @ w), np.sort(halves[1][1] @ w)
    best = 1.0
    for cut in np.quantile(own, np.linspace(0.0, 0.5, 51)):
        above, others = (own >= cut).mean(), (web >= cut).mean()
        slack = np.sqrt(others * (1 - others) / max(len(web), 1)) + np.sqrt(above * (1 - above) / max(len(own), 1))
        best = min(best, (others + slack) / above)
    return float(np.clip(best, 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 1e-4, steps: int = 600) -> np.ndarray:
    """Weights that minimise the non-negative risk with logistic loss. When
    the negative part falls below zero, the step goes against it, as the
    non-negative estimator asks."""
    def gradient(w):
        p, u = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        negative = np.logaddexp(0, unlabelled @ w).mean() - prior * np.logaddexp(0, positive @ w).mean()
        g_positive = prior * positive.T @ (p - 1) / len(p)
        g_negative = unlabelled.T @ u / len(u) - prior * positive.T @ p / len(p)
        return (g_positive + g_negative if negative >= 0 else -g_negative) + ridge * w
    return _descend(positive, gradient, steps)


def _scored(mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float):
    def run(batches):
        for b in slices(batches):
            x = np.array([features(t) for t in texts(b.column("text"))]).reshape(-1, len(mean))
            score = _sigmoid(np.column_stack([(x - mean) / spread, np.ones(len(x))]) @ weights)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("held_out"), pa.array(score),
                                              pa.array((score >= threshold).astype(np.int32))], ["row", *RESULTS])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality", threshold: float = THRESHOLD, positive_rows: int = POSITIVE_ROWS,
                  unlabelled_rows: int = UNLABELLED_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of ``docs`` with RESULTS: whether no label of the row was
    used, the probability of good quality, and whether that reaches
    ``threshold``.

    Fitted on at most ``positive_rows`` labelled good texts and
    ``unlabelled_rows`` texts of ``docs``, at most ``sample_bytes`` of each.
    No label of bad quality is used. A null or blank text scores like an
    empty one. Without positives every row scores 0.5. Repeated rows score
    alike; an empty table gives an empty table. Results replace input columns
    of their names."""
    ready(docs.sparkSession)
    good = learnable(docs, labels, doc_id, text, label).filter(F.col("label") == 1)
    picked = [np.array([features(t.encode()) for t in sample]) for sample in (
        sample_texts(docs, good, doc_id, text, positive_rows, sample_bytes),
        sample_texts(docs, keyed(docs, doc_id, text), doc_id, text, unlabelled_rows, sample_bytes))]
    size = len(features(b""))
    if min(map(len, picked)) < 4:
        mean, spread, weights = np.zeros(size), np.ones(size), np.zeros(size + 1)
    else:
        mean, spread = picked[1].mean(0), picked[1].std(0) + 1e-3
        positive, unlabelled = (np.column_stack([(x - mean) / spread, np.ones(len(x))]) for x in picked)
        weights = fit(positive, unlabelled, class_prior(positive, unlabelled))
    work = packed(docs, text=quoted(text), held_out=held_out(quoted(doc_id)))
    row = row_ddl(work)
    scored = work.mapInArrow(_scored(mean, spread, weights, threshold),
                             f"row {row}, held_out boolean, score double, predicted int")
    return unpacked(scored, docs.columns, RESULTS)
