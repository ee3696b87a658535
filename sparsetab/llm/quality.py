"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal.

The n-grams are of words (lower case, runs of one and two) and of their forms (runs of one to three).  The form of
a word keeps its punctuation and folds runs of capitals, small letters and digits to one sign each (``Abc,`` is
``Aa,``); a word that equals the one before it has a form of its own.  The value of an n-gram is its frequency
among the n-grams of its kind, times ``SCALE``.  A score is one sparse dot product: weights are gathered by hash and
averaged by document, in one pass over the text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.llm.ftrl import BIAS, Ftrl, sigmoid
from sparsetab.llm.tokens import BYTE_CODES, RangeHash, mix, slices, span_hashes, sums_of, words_of

BITS = 18
SCALE = 10.0
ROWS = 4000  # documents of the sample a model is fitted on
_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91], _FORM[97:123], _FORM[48:58], _FORM[128:] = 65, 97, 48, 97
_LETTER_FORMS = np.zeros(256, dtype=bool)
_LETTER_FORMS[[65, 97, 48]] = True


def _forms(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's form."""
    form = _FORM[np.frombuffer(data, dtype=np.uint8)]
    kept = np.ones(len(form), dtype=bool)
    kept[1:] = (form[1:] != form[:-1])
    rank = np.zeros(len(form) + 1, dtype=np.int64)
    np.cumsum(kept, out=rank[1:])
    return RangeHash(BYTE_CODES[form[kept]]).of(rank[starts], rank[ends])


def features(parts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of texts: an array of feature numbers by kind, -1 where a run would cross a text's end; word bounds."""
    data, starts, ends, bounds = words_of(parts)
    if not len(starts):
        return [np.zeros(0, dtype=np.int64)] * 5, bounds
    low = span_hashes(_LOWER[np.frombuffer(data, dtype=np.uint8)].tobytes(), starts, ends)
    form = _forms(data, starts, ends)
    first = np.zeros(len(starts) + 1, dtype=bool)
    first[bounds] = True
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (low[1:] == low[:-1]) & ~first[1:-1]
    form[same] = np.uint64(1)
    kinds = []
    for kind, (codes, k) in enumerate(((low, 1), (low, 2), (form, 1), (form, 2), (form, 3))):
        h = codes * np.uint64(2 * kind + 3)
        gone = np.zeros(len(h), dtype=bool)
        for i in range(1, k):
            h[:-i] = mix(h[:-i]) + codes[i:]
            gone[-i:] = True
            gone[:-i] |= first[i:-1]
        idx = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
        idx[idx == BIAS] = 1
        idx[gone] = -1
        kinds.append(idx)
    return kinds, bounds


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vector of each text, its numbers and values as bytes."""
    for batch, texts in slices(batches, "text", _BYTES):
        kinds, bounds = features(texts)
        numbers, values = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            idx, val = [np.array([BIAS])], [np.ones(1)]
            for kind in kinds:
                own = kind[a:b]
                own, count = np.unique(own[own >= 0], return_counts=True)
                idx.append(own)
                val.append(SCALE * count / max(1, count.sum()))
            numbers.append(np.concatenate(idx).astype(np.int32).tobytes())
            values.append(np.concatenate(val).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array(numbers, pa.binary()), pa.array(values, pa.binary())], ["y", "idx", "val"])


def fit(sample: DataFrame, epochs: int = 4, alpha: float = 0.2, l1: float = 0.2, l2: float = 1.0) -> np.ndarray:
    """Weights from ``sample(text, y)``, which the caller bounds (``samples.labelled``).

    Vectors are made on the executors; the updates are sequential and run on the driver, over the bounded sample.
    An empty sample gives zero weights, that is a score of 0.5 for every text.
    """
    rows = sample.select("text", "y").mapInArrow(_vectors, "y double, idx binary, val binary").collect()
    rows.sort(key=lambda r: (r["idx"], r["y"]))
    model = Ftrl(1 << BITS, alpha=alpha, l1=l1, l2=l2)
    data = [(r["y"], *_summed(np.frombuffer(r["idx"], dtype=np.int32), np.frombuffer(r["val"], dtype=np.float32))) for r in rows]
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            y, idx, val = data[i]
            w = model.at(idx)
            model.update(idx, w, (sigmoid(w @ val) - y) * val)
    return model.weights()


def _summed(idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number once; kinds may collide."""
    own, at = np.unique(idx, return_inverse=True)
    return own, np.bincount(at, weights=val)


def score_texts(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    kinds, bounds = features(texts)
    total = np.full(len(texts), float(weights[BIAS]))
    for idx in kinds:
        there = idx >= 0
        n = sums_of(there.astype(np.float64), bounds)
        total += SCALE * sums_of(np.where(there, weights[idx], 0.0), bounds) / np.maximum(n, 1.0)
    return sigmoid(total)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs(id columns..., text)`` with ``text`` replaced by ``score``, the chance of label 1.

    Null and empty texts have no n-grams and score as the bias alone.  Other columns pass through; `a column ``score`` is replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "score")]

    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(score_texts(texts, weights))], [*others, "score"])

    schema = docs.select(*others).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
