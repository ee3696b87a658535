"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence is a run between ``.``, ``!``, ``?`` and line ends; its score is a logistic function of the sum of the
weights of its terms (runs of letters, lower case in ASCII) and of their beginnings of four, five and six bytes, which
stand for the forms of a word; all are hashed.  The chance of a document is the noisy-or of its
sentences.  Only documents are labelled: the gradient of the noisy-or tells each sentence its share, so the model
learns which sentences offend.  Updates are FTRL-proximal with weights of 0 or more: a term can speak against a
sentence, none can excuse it.  Terms that few documents of the sample use get no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.llm.ftrl import BIAS, Ftrl, sigmoid
from sparsetab.llm.tokens import joined, mix, slices, span_hashes

BITS = 20
ROWS = 6000  # documents of the sample a model is fitted on
LEAST_DOCS = 5  # documents of the sample that must use a term
BEGINNINGS = (4, 5, 6)
START_BIAS = -3.0
_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x2E, 0x21, 0x3F, 0x0A, 0x0D]] = True


def terms(parts: list[bytes | None]):
    """Terms of texts: feature numbers (-1 for none), number of the sentence of each, term bounds by text, and sentence offsets in bytes."""
    data, offsets = joined(parts)
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    letter = np.zeros(len(raw) + 2, dtype=bool)
    letter[1:-1] = _LETTER[raw]
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[0::2], edges[1::2]
    own = raw.tobytes()
    idx = np.full((len(starts), 1 + len(BEGINNINGS)), -1, dtype=np.int64)
    idx[:, 0] = (span_hashes(own, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    for i, n in enumerate(BEGINNINGS, 1):
        long = ends - starts > n
        idx[long, i] = (mix(span_hashes(own, starts[long], starts[long] + n) + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64)
    idx[idx == BIAS] = 1
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = idx[1:, 0] == idx[:-1, 0]
    idx[same] = -1  # a word said over and over counts once
    cuts = np.unique(np.concatenate([np.flatnonzero(_ENDS[raw]) + 1, offsets]))
    return idx, np.searchsorted(cuts, starts, side="right") - 1, np.searchsorted(starts, offsets), cuts, offsets


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text", _BYTES):
        idx, sentence, bounds, _, _ = terms(texts)
        own = [(idx[a:b], np.repeat((sentence[a:b] - sentence[a:a + 1])[:, None], idx.shape[1], axis=1)) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array([x[x >= 0].astype(np.int32).tobytes() for x, _ in own], pa.binary()),
             pa.array([n[x >= 0].astype(np.int32).tobytes() for x, n in own], pa.binary())], ["y", "idx", "sentence"])


def fit(sample: DataFrame, epochs: int = 8, alpha: float = 2.0, l1: float = 2.0, l2: float = 0.1) -> np.ndarray:
    """Weights from ``sample(text, y)``, which the caller bounds; an empty sample gives the starting bias alone."""
    rows = sample.select("text", "y").mapInArrow(_bags, "y double, idx binary, sentence binary").collect()
    rows.sort(key=lambda r: (r["idx"], r["y"]))
    data = [(r["y"], np.frombuffer(r["idx"], dtype=np.int32), np.frombuffer(r["sentence"], dtype=np.int32)) for r in rows]
    used = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(np.unique(idx) for _, idx, _ in data)]), minlength=1 << BITS) >= LEAST_DOCS
    model, order = Ftrl(1 << BITS, alpha=alpha, l1=l1, l2=l2, bias=START_BIAS, positive=True), np.random.default_rng(1)
    bags = []
    for y, idx, sentence in data:
        keep = used[idx]
        own, at = np.unique(np.concatenate([[BIAS], idx[keep]]), return_inverse=True)
        _, group = np.unique(sentence, return_inverse=True)
        bags.append((y, own, at[1:], group[keep], int(group.max()) + 1 if len(group) else 0))
    for _ in range(epochs):
        for i in order.permutation(len(bags)):
            y, own, at, group, n = bags[i]
            if not n:
                continue
            w = model.at(own)
            p = sigmoid(w[0] + np.bincount(group, weights=w[at], minlength=n))
            whole = -np.expm1(np.log1p(-p).sum())
            pull = p if y < 0.5 else -p * (1.0 - whole) / max(whole, 1e-12)
            gradient = np.bincount(at, weights=pull[group], minlength=len(own))
            gradient[0] += pull.sum()
            model.update(own, w, gradient)
    return model.weights()


def _sentences(texts: list[bytes | None], weights: np.ndarray):
    """Score of each sentence that has a term, its number, its text's number, and the cuts."""
    idx, sentence, bounds, cuts, offsets = terms(texts)
    own, first = np.unique(sentence, return_index=True)
    of_term = np.where(idx >= 0, weights[idx], 0.0).sum(axis=1, dtype=np.float64)
    total = np.add.reduceat(of_term, first) if len(own) else np.zeros(0)
    return sigmoid(float(weights[BIAS]) + total), own, np.searchsorted(bounds, first, side="right") - 1, cuts, offsets


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs(id columns..., text)`` with ``text`` replaced by ``score``, the noisy-or of its sentences.

    Texts without a term (null, empty, no letter) have no sentence and score 0.  A column ``score`` is replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "score")]

    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            p, _, text, _, _ = _sentences(texts, weights)
            score = -np.expm1(np.bincount(text, weights=np.log1p(-p), minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(score)], [*others, "score"])

    return docs.mapInArrow(run, docs.select(*others).withColumn("score", F.lit(0.0)).schema)


def offending(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """Sentences that score ``threshold`` or more: id columns, ``sentence_score``, ``sentence`` and its byte offset in the text."""
    others = [c for c in docs.columns if c not in ("text", "sentence_score", "sentence", "at")]

    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            p, own, text, cuts, offsets = _sentences(texts, weights)
            hit = np.flatnonzero(p >= threshold)
            at = [int(cuts[own[i]] - offsets[text[i]]) for i in hit]
            to = [int(cuts[own[i] + 1] - offsets[text[i]]) if own[i] + 1 < len(cuts) else None for i in hit]
            found = [texts[text[i]][a:b].decode("utf-8", "replace").strip() for i, a, b in zip(hit, at, to)]
            rows = batch.take(pa.array(text[hit]))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in others), pa.array(p[hit], pa.float64()), pa.array(found, pa.string()), pa.array(at, pa.int64())],
                [*others, "sentence_score", "sentence", "at"])

    schema = docs.select(*others).withColumn("sentence_score", F.lit(0.0)).withColumn("sentence", F.lit("")).withColumn("at", F.lit(0).cast("long")).schema
    return docs.mapInArrow(run, schema)
