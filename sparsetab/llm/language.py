"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads one word at a time, forwards and backwards, and gives every byte a distribution over languages.
Its state starts anew at each word, so equal words get equal labels and a task runs each distinct word of a batch of
text once.  Runs without white space are read in pieces of ``LONGEST`` bytes.  A document's distribution is the mean
over its letters.  Capitals are read as small letters and ASCII signs and digits as one code, so layout and junk do
not speak for a language.

Training is backpropagation through time in NumPy with Adam, on the driver, over a bounded sample of words by
language (``samples`` below); everything else is a pass over the text without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsetab.llm.tokens import slices, span_hashes, words_of

LONGEST = 32
DOCS = 300  # documents of a language that the sample of words is drawn from
WORDS = 5000  # words of a language in the sample
UNITS = 12  # of each direction
_BYTES = 1 << 21
_ROWS = 4096

_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)
_CODES = 155


class Model:
    """Weights of both directions (byte rows and recurrent matrix, gates update, reset, candidate) and of the output."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.languages = languages
        f = np.float32
        self.parts = {}
        for side in ("f", "b"):
            self.parts["E" + side] = (draw.normal(0, 0.3, (_CODES, 3 * units))).astype(f)
            self.parts["U" + side] = (draw.normal(0, 1 / np.sqrt(units), (units, 3 * units))).astype(f)
            self.parts["O" + side] = (draw.normal(0, 0.3, (units, len(languages)))).astype(f)
        self.parts["c"] = np.zeros(len(languages), dtype=f)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _step(inputs, h, U, units):
    a = h @ U
    gates = _sigmoid(inputs[:, :2 * units] + a[:, :2 * units])
    z, r = gates[:, :units], gates[:, units:]
    c = np.tanh(inputs[:, 2 * units:] + r * a[:, 2 * units:])
    return z, r, c, a[:, 2 * units:], c + z * (h - c)


def _run(model: Model, codes: np.ndarray, side: str, keep: list | None = None) -> list[np.ndarray]:
    """States after each byte of words of one length, in order of position."""
    E, U = model.parts["E" + side], model.parts["U" + side]
    units = U.shape[0]
    h = np.zeros((len(codes), units), dtype=np.float32)
    states: list = [None] * codes.shape[1]
    for t in (range(codes.shape[1]) if side == "f" else reversed(range(codes.shape[1]))):
        z, r, c, a, new = _step(E[codes[:, t]], h, U, units)
        if keep is not None:
            keep.append((t, h, z, r, c, a))
        h = states[t] = new
    return states


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def label_words(model: Model, codes: np.ndarray) -> np.ndarray:
    """Distribution over languages at each byte of words of one length: (words, bytes, languages)."""
    p = model.parts
    forward, backward = _run(model, codes, "f"), _run(model, codes, "b")
    return np.stack([_probabilities(f @ p["Of"] + b @ p["Ob"] + p["c"]) for f, b in zip(forward, backward)], axis=1)


def _gradients(model: Model, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over letters; one pass back through time for each direction."""
    p = model.parts
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: _run(model, codes, side, kept[side]) for side in "fb"}
    letters = codes > 0
    total = max(1, int(letters.sum()))
    errors = []
    for t in range(codes.shape[1]):
        d = _probabilities(states["f"][t] @ p["Of"] + states["b"][t] @ p["Ob"] + p["c"])
        d[np.arange(len(y)), y] -= 1.0
        d *= (letters[:, t] / total)[:, None].astype(np.float32)
        grads["c"] += d.sum(axis=0)
        for side in "fb":
            grads["O" + side] += states[side][t].T @ d
        errors.append(d)
    for side in "fb":
        E, U, O = p["E" + side], p["U" + side], p["O" + side]
        units = U.shape[0]
        back = np.zeros((len(codes), units), dtype=np.float32)
        for t, h, z, r, c, a in reversed(kept[side]):
            dh = back + errors[t] @ O.T
            dc = dh * (1.0 - z) * (1.0 - c * c)
            dz = dh * (h - c) * z * (1.0 - z)
            dr = dc * a * r * (1.0 - r)
            inputs = np.concatenate([dz, dr, dc], axis=1)
            through = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(grads["E" + side], codes[:, t], inputs)
            grads["U" + side] += h.T @ through
            back = dh * z + through @ U.T
    return grads


def train(words: list[tuple[bytes, int]], languages: list[str], epochs: int = 5, rate: float = 0.01, batch: int = 256, seed: int = 1) -> Model:
    """Model from words and the number of the language of each; words of one length go together."""
    model, draw = Model(languages, seed=seed), np.random.default_rng(seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, y in words:
        for piece in (word[i:i + LONGEST] for i in range(0, len(word), LONGEST)):
            by_length.setdefault(len(piece), []).append((piece, y))
    groups = {n: (_CODE[np.frombuffer(b"".join(w for w, _ in rows), dtype=np.uint8).reshape(-1, n)], np.array([y for _, y in rows])) for n, rows in by_length.items()}
    first, second = ({k: np.zeros_like(v) for k, v in model.parts.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = [(n, i) for n, (codes, _) in groups.items() for i in np.array_split(draw.permutation(len(codes)), -(-len(codes) // batch))]
        for at in draw.permutation(len(order)):
            n, rows = order[at]
            codes, y = groups[n]
            step += 1
            for k, g in _gradients(model, codes[rows], y[rows]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.parts[k] -= rate * (0.5 ** epoch) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def samples(docs: DataFrame, usable: Column, docs_each: int = DOCS, words_each: int = WORDS) -> DataFrame:
    """At most ``words_each`` words of each language, from at most ``docs_each`` documents, drawn by hash of the text.

    Words of more than ``LONGEST`` bytes are several, about that long and cut between characters.  Copies of a text count once.  ``docs(text, lang)``; rows without text or language, and those that are not ``usable``, are left out.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & usable).select("lang", "text", F.xxhash64("text").alias("_d"))
    # hashes are ranked, not texts; at most docs_each of them for each language are sent back to the texts
    ids = _least(rows.select("lang", "_d").distinct(), F.col("_d"), ["_d"], docs_each)
    drawn = rows.join(F.broadcast(ids), ["lang", "_d"]).distinct()  # copies of a text are one document
    words = drawn.select("lang", "_d", F.posexplode(F.split("text", r"[\x20\x09-\x0D]+")).alias("_p", "word")).where("word <> ''")
    size = F.greatest(F.lit(1), F.floor(LONGEST / F.ceil(F.octet_length("word") / F.length("word")))).cast("int")
    pieces = words.withColumn("_size", size).select("lang", "_d", "_p", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("word") - 1) / F.col("_size")).cast("int")),
        lambda i: F.substring(F.col("word"), i * F.col("_size") + 1, F.col("_size")))).alias("_q", "word"))
    return _least(pieces.withColumn("_w", F.xxhash64("_d", "_p")), F.col("_w"), ["_w", "_q", "word"], words_each).select("lang", "word")


def _least(rows: DataFrame, draw: Column, order: list[str], most: int) -> DataFrame:
    """The ``most`` rows of each language that are least in ``order``, whose first column is the hash ``draw``.

    Rows are counted by the first bits of the hash, and only those up to the bits where ``most`` is reached are ranked:
    one task ranks little more than ``most`` rows, however many a language has.  What is broadcast is a row a language, as
    many as the model has outputs.
    """
    bits = F.shiftright(draw, 48)
    by_bits = Window.partitionBy("lang").orderBy("_bits")
    counts = rows.groupBy("lang", bits.alias("_bits")).agg(F.count("*").alias("_c")).withColumn("_sum", F.sum("_c").over(by_bits) - F.col("_c"))
    last = counts.where(F.col("_sum") < most).groupBy(F.col("lang").alias("_lang")).agg(F.max("_bits").alias("_last"))
    near = rows.join(F.broadcast(last), F.col("lang") == F.col("_lang")).where(bits <= F.col("_last")).drop("_lang", "_last")
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def fit(docs: DataFrame, usable: Column) -> Model:
    """Trains on ``samples(docs, usable)``; without a usable row the model knows no language."""
    rows = sorted((r["lang"], r["word"]) for r in samples(docs, usable).collect())
    languages = sorted({lang for lang, _ in rows})
    at = {lang: i for i, lang in enumerate(languages)}
    return train([(word.encode(), at[lang]) for lang, word in rows], languages) if rows else Model([])


def _distinct(parts: list[bytes | None]):
    """Distinct pieces of words of texts: bytes of all texts, bounds of each, number of the piece at each place, piece bounds by text."""
    data, starts, ends, bounds = words_of(parts)
    if len(starts) and (ends - starts).max() > LONGEST:
        n = -(-(ends - starts) // LONGEST)
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(first[-1]) - np.repeat(first[:-1], n)
        last = np.repeat(ends, n)
        starts = np.repeat(starts, n) + place * LONGEST
        ends, bounds = np.minimum(starts + LONGEST, last), first[bounds]
    _, one, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return np.frombuffer(data, dtype=np.uint8), starts[one], ends[one], at, bounds


def _by_length(model: Model, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words of one length at a time: their numbers, codes and distributions."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        for i in range(0, len(same), _ROWS):
            own = same[i:i + _ROWS]
            codes = _CODE[raw[starts[own][:, None] + np.arange(lengths[own[0]])]]
            yield own, codes, label_words(model, codes)


def pooled(parts: list[bytes | None], model: Model) -> np.ndarray:
    """Mean distribution over the letters of each text; zeros where it has none."""
    raw, starts, ends, at, bounds = _distinct(parts)
    k = len(model.languages)
    if not len(starts) or not k:
        return np.zeros((len(parts), k))
    sums = np.zeros((len(starts), k + 1), dtype=np.float32)
    for own, codes, p in _by_length(model, raw, starts, ends):
        letters = (codes > 0).astype(np.float32)
        sums[own, :k] = np.einsum("nt,ntk->nk", letters, p)
        sums[own, k] = letters.sum(axis=1)
    out = np.zeros((len(parts), k + 1))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        out[i] = sums[at[a:b]].sum(axis=0, dtype=np.float64)
    return out[:, :k] / np.maximum(out[:, k:], 1.0)


def positions(text: bytes, model: Model) -> list[str | None]:
    """Language of every byte of a text; None for white space."""
    raw, starts, ends, at, _ = _distinct([text])
    if not model.languages:
        return [None] * len(text)
    best: dict[int, np.ndarray] = {}
    for own, _, p in _by_length(model, raw, starts, ends):
        best.update(zip(own.tolist(), p.argmax(axis=2)))
    _, word_starts, word_ends, _ = words_of([text])
    out: list[str | None] = [None] * len(text)
    pieces = iter(at.tolist())
    for a, b in zip(word_starts, word_ends):
        for i in range(a, b, LONGEST):
            for j, k in enumerate(best[next(pieces)]):
                out[i + j] = model.languages[k]
    return out


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs(id columns..., text)`` with ``text`` replaced by ``lang_pred`` and ``score``, the chance of that language.

    ``und`` with score 0 for a text that is null or has no letter, and where the model knows no language.  Other
    columns pass through, with ``keep_text`` the text too; columns of the new names are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "_letter") and (keep_text or c != "text")]

    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            letter = batch.column("_letter").to_pylist()
            p = pooled(texts, model)
            best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(texts), dtype=int)
            known = [bool(x) and p.shape[1] > 0 for x in letter]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others),
                 pa.array([model.languages[b] if ok else "und" for b, ok in zip(best, known)], pa.string()),
                 pa.array([float(min(1.0, p[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known))], pa.float64())],
                [*others, "lang_pred", "score"])

    schema = docs.select(*others).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.withColumn("_letter", F.col("text").rlike(r"\p{L}")).mapInArrow(run, schema)
