"""Operator 1, toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary texts, one
on what of the toxic texts' windows ordinary text doesn't explain, runs of
words that ordinary texts hardly have. Every window of a
text is compressed with the ordinary dictionary alone and with both, the
toxic one first, so that it serves only where it has the longer match; the
bytes saved tell how much of it only toxic text explains. The savings of a
whole text, summed above a threshold, are calibrated to a probability on
labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, packed, quoted, ready, row_ddl, slices, texts, unpacked
from quire.llm.labelled import learnable, sample_texts

#: Words of a window.
WINDOW = 16
#: Bounds of the labelled sample: texts of each label, and their bytes.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 3000, 3000, 8 << 20
ORDINARY_BYTES, TOXIC_BYTES = 1 << 16, 1 << 14
#: A word is toxic material if toxic texts have it in this many surroundings
#: and this many times as often as ordinary texts. Surroundings are the words
#: some places before and after it, so that copies of a text count once: the
#: neighbours, or words far enough off that a fixed phrase lies between them.
LEAST_PLACES, LEAST_LIFT, REACHES = 3, 8, (1, 8)
RESULTS = ["held_out", "score", "predicted"]


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    words = text.decode().lower().encode().split()
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; too few samples are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes):
    """Lengths of windows compressed with a dictionary."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=5, hash_log=17, chain_log=17, window_log=18,
        target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
    prefix = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prefix.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=prefix, compression_params=params).compress
    return lambda parts: np.fromiter((len(compress(p)) for p in parts), np.int64, len(parts))


def surroundings(part: list[list[bytes]]) -> Counter:
    """In how many surroundings the texts have each word, by the reach that
    tells more of them apart."""
    out: Counter = Counter()
    for reach in REACHES:
        edge = [b""] * reach
        out |= Counter(w for w, *_ in {c for t in part for c in zip(t, edge + t, t[reach:] + edge)})
    return out


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    words = [[x.decode().lower().encode().split() for x in part] for part in (toxic, ordinary)]
    there, elsewhere = (surroundings(part) for part in words)
    rate = (len(ordinary) + 1) / max(len(toxic), 1)
    chosen = {w for w, n in there.items() if n >= LEAST_PLACES and n * rate >= LEAST_LIFT * (elsewhere[w] + 1)}
    material = [b" " + b" ".join(run) + b" " for text in words[0]
                for own, run in groupby(text, chosen.__contains__) if own]
    plain = [p for text in ordinary for p in windows(text, 8)]
    return (_dictionary(plain, ORDINARY_BYTES) if plain else b" ",
            _dictionary(material, TOXIC_BYTES) if material else b" ")


def features(text: bytes, plain, both) -> list[float]:
    """Savings of a text: the largest of a window, the sums and means above
    the thresholds of one to four bytes, and their counts."""
    parts = windows(text)
    saved = plain(parts) - both(parts) if parts else np.zeros(1, np.int64)
    n = len(saved)
    out = [1.0, float(np.log1p(n)), float(np.clip(saved.max(), -4, 24))]
    for least in (1, 2, 4):
        over = float(np.maximum(saved - least, 0).sum())
        out += [float(np.log1p(over)), float(np.log1p(8 * over / n)), float(np.log1p(8 * (saved > least).sum() / n))]
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], odds: float | None = None) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries from all texts, and weights: every third of the texts is
    scored with dictionaries of the other two. The intercept is moved from
    the samples' odds to ``odds``, those of all labelled rows."""
    if not toxic or not ordinary:
        return b" ", b" ", [float(np.log((len(toxic) + 1) / (len(ordinary) + 1)))] + [0.0] * 11
    x, y = [], []
    for k in range(3):
        own = [[t for i, t in enumerate(part) if i % 3 == k] for part in (toxic, ordinary)]
        rest = [[t for i, t in enumerate(part) if i % 3 != k] for part in (toxic, ordinary)]
        content = train_dictionaries(*rest)
        plain, both = compressor(content[0]), compressor(content[1] + content[0])
        x += [features(t, plain, both) for part in own for t in part]
        y += [1.0] * len(own[0]) + [0.0] * len(own[1])
    weights = calibrate(np.array(x), np.array(y))
    weights[0] += np.log(odds * len(ordinary) / len(toxic)) if odds else 0.0
    return *train_dictionaries(toxic, ordinary), weights.tolist()


def _scored(model: tuple[bytes, bytes, list[float]]):
    def run(batches):
        plain, both = compressor(model[0]), compressor(model[1] + model[0])
        weights = np.array(model[2])
        for b in slices(batches):
            x = np.array([features(t, plain, both) for t in texts(b.column("text"))]).reshape(-1, len(weights))
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("held_out"), pa.array(score),
                                              pa.array((score >= 0.5).astype(np.int32))], ["row", *RESULTS])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   label: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS,
                   sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of ``docs`` with RESULTS: whether no label of the row was
    used, the probability that it is toxic, and whether that reaches 0.5.

    The model is fitted on at most ``toxic_rows`` and ``ordinary_rows``
    different labelled texts, together at most ``sample_bytes`` of each
    label. A null or blank text has one window that saves nothing. Without
    labels of both kinds every row gets the same score. Repeated rows score
    alike; an empty table gives an empty table. Results replace input columns
    of their names."""
    ready(docs.sparkSession)
    known = learnable(docs, labels, doc_id, text, label)
    picked = [[t.encode() for t in sample_texts(docs, known.filter(F.col("label") == v), doc_id, text, n, sample_bytes)]
              for v, n in ((1, toxic_rows), (0, ordinary_rows))]
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    odds = counts[1] / counts[0] if counts.get(0) and counts.get(1) else None
    model = docs.sparkSession.sparkContext.broadcast(fit(*picked, odds))
    work = packed(docs, text=quoted(text), held_out=held_out(quoted(doc_id)))
    row = row_ddl(work)
    scored = work.mapInArrow(_from(model), f"row {row}, held_out boolean, score double, predicted int")
    return unpacked(scored, docs.columns, RESULTS)


def _from(model):
    return lambda batches: _scored(model.value)(batches)
