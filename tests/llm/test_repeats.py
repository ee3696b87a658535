"""Substring and suffix-array dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsetab.llm import repeats, substrings, suffixes
from sparsetab.llm.tokens import words_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def split(text, unit):
    raw = (text or "").encode()
    return WORD.findall(raw) if unit == "words" else [raw[i:i + 1] for i in range(len(raw))]


def marked(tokens, size, hit):
    out = [False] * len(tokens)
    for i in range(len(tokens) - size + 1):
        if hit(i, tuple(tokens[i:i + size])):
            out[i:i + size] = [True] * size
    return out


def brute(rows, hashes, size, unit, keep_first):
    tokens = [split(text, unit) for _, text in rows]
    counts = Counter(tuple(t[i:i + size]) for t in tokens for i in range(len(t) - size + 1))
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashes[k])):
        for i in range(len(tokens[k]) - size + 1):
            first.setdefault(tuple(tokens[k][i:i + size]), (rows[k], i))
    return [marked(t, size, (lambda i, w, row=row: first[w] != (row, i)) if keep_first else lambda i, w: counts[w] > 1) for row, t in zip(rows, tokens)]


def corpus(seed, letters, unit):
    draw = random.Random(seed)
    passage = " ".join(f"p{draw.randrange(letters)}" for _ in range(30))
    rows = []
    for d in range(50):
        text = " ".join(f"w{draw.randrange(3 * letters)}" for _ in range(draw.randrange(40)))
        if draw.random() < 0.6:
            text += draw.choice([" ", "\n", ""]) + passage[draw.randrange(10):len(passage) - draw.randrange(10)] + f" z{draw.randrange(9)} end"
        rows.append((d, text + ("é日" if unit == "bytes" else "")))
    # null and empty texts, a null id, an id with two texts, a row given twice, a long text
    return rows + [(100, None), (101, ""), (102, " \n\t "), (None, rows[0][1]), (3, "other text " + passage), rows[7], (103, (passage + " x y ") * 40)]


@pytest.mark.parametrize("seed, unit, size, letters, classes, keep_first", [
    (1, "words", 1, 4, 256, False), (2, "words", 3, 2, 2, False), (3, "words", 9, 30, 1, False), (4, "words", 5, 4, 3, True),
    (5, "bytes", 3, 30, 3, False), (6, "bytes", 20, 4, 256, False), (7, "bytes", 9, 4, 2, True), (8, "words", 20, 30, 256, True),
])
def test_against_brute_force(spark, seed, unit, size, letters, classes, keep_first):
    rows = corpus(seed, letters, unit)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.hash("text"))
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.collect()}
    solve = substrings.subtree if unit == "words" else suffixes.matched
    found = {(r["_id"], r["_h"]): r["runs"] for r in repeats.repeated(docs, size, unit, keep_first, solve, "doc_id", classes).collect()}
    got = [repeats.covered(found.get((d, hashes[(d, t)])), len(split(t, unit)), size).tolist() for d, t in rows]
    assert got == brute(rows, [hashes[r] for r in rows], size, unit, keep_first)


def test_word_dedup_texts(spark):
    passage = " ".join(f"w{i}" for i in range(6))
    rows = [(1, f"a  b\n{passage}\tc"), (2, f"{passage} d"), (3, "lone words"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key long, n_words long")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup(docs, 5).collect()}
    assert got == {1: (9, 6, "a b c"), 2: (7, 6, "d"), 3: (2, 0, "lone words"), 4: (0, 0, ""), 5: (0, 0, "")}
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(docs, 5, keep_first=True, layout=True).collect()}
    assert got == {1: f"a  b\n{passage}\tc", 2: "d", 3: "lone words", 4: None, 5: ""}


def test_byte_dedup_spans(spark):
    rows = [("x", "abcdefgh-1-abcdefgh"), ("y", "zzabcdefgh"), ("z", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    every = {r["doc_id"]: r for r in suffixes.dedup(docs, 8, keep_first=False).collect()}
    assert [tuple(s) for s in every["x"]["spans"]] == [(0, 8), (11, 8)] and every["x"]["kept"] == b"-1-" and every["y"]["kept"] == b"zz"
    assert (every["z"]["n_bytes"], every["z"]["n_removed"], every["z"]["spans"]) == (0, 0, [])
    later = {r["doc_id"]: r["kept"] for r in suffixes.dedup(docs, 8).collect()}
    assert later == {"x": b"abcdefgh-1-", "y": b"zz", "z": b""}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substrings.dedup(docs).count() == 0 and suffixes.dedup(docs).count() == 0


def test_deep_nodes_and_names():
    draw = np.random.default_rng(5)
    codes = draw.integers(1, 4, 400).astype(np.uint64)
    for size in (1, 2, 7, 13):
        starts = np.arange(len(codes) - size + 1)
        keys = [tuple(codes[i:i + size]) for i in starts]
        counts = Counter(keys)
        node, name = substrings.deep_nodes(codes, starts, size), repeats.names(codes, starts, size, min(4, size))
        assert [n >= 0 for n in node] == [counts[k] > 1 for k in keys]
        for labels in (node[node >= 0], name):
            own = keys if labels is name else [k for k in keys if counts[k] > 1]
            assert len(set(zip(labels.tolist(), own))) == len(set(own)) == len(set(labels.tolist()))


def test_factors():
    """Longest previous and next factors against a loop over all pairs, places in any order."""
    draw = np.random.default_rng(6)
    for letters, size, n in ((2, 7, 120), (4, 12, 200), (1, 9, 60), (30, 5, 150)):
        codes = draw.integers(1, letters + 1, n).astype(np.uint64)
        starts = np.flatnonzero(draw.random(n - size + 1) < 0.7)
        place = draw.permutation(len(starts) * 3)[:len(starts)]
        earlier, later = suffixes.factors(codes, starts, place, size)
        for i, a in enumerate(starts):
            shared = [next((k for k in range(size) if codes[a + k] != codes[b + k]), size) for b in starts]
            assert earlier[i] == max((s for j, s in enumerate(shared) if place[j] < place[i]), default=0)
            assert later[i] == max((s for j, s in enumerate(shared) if place[j] > place[i]), default=0)


def test_nearest_smaller():
    draw = np.random.default_rng(7)
    for v in (draw.permutation(300), np.arange(50), np.arange(50)[::-1], np.zeros(0, dtype=np.int64)):
        prefix = draw.integers(0, 9, len(v))
        want = [next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1) for i in range(len(v))]
        at, least = suffixes.nearest_smaller(v, prefix)
        assert at.tolist() == want and all(least[i] == prefix[at[i] + 1:i + 1].min() for i in range(len(v)) if at[i] >= 0)


def test_sliding_least_and_words():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 50):
        assert repeats.sliding_least(x, width).tolist() == [x[i:i + width].min() for i in range(50 - width + 1)]
    texts = ["a bb\tc", None, "", "\x0b\x0cd e  f ", "x" * 3000000]
    data, starts, ends, bounds = words_of([t.encode() if t is not None else None for t in texts])
    got = [[data[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(bounds[:-1], bounds[1:])]
    assert got == [WORD.findall((t or "").encode()) for t in texts]


def test_rows_with_null_ids_and_equal_hashes(spark):
    """Two texts whose 32-bit hashes are equal are told apart, whatever their ids."""
    long = F.concat(F.lit(" ".join(f"w{i}" for i in range(60)) + " v"), F.col("id"))
    short = F.concat(F.lit("short "), F.col("id"))
    texts = spark.range(200_000)
    pair = texts.select(long.alias("a"), F.hash(long).alias("h")).join(texts.select(short.alias("b"), F.hash(short).alias("h")), "h").orderBy("a", "b").first()
    assert pair is not None
    rows = [(None, pair["a"]), (None, pair["b"]), (None, "w0 " + pair["a"][3:] + " more"), (7, pair["b"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup(docs).collect())
    assert got == sorted([(61, 61, ""), (62, 61, "more"), (2, 0, pair["b"]), (2, 0, pair["b"])])
    spans = {bytes(r["kept"]).decode(): r["n_removed"] for r in suffixes.dedup(docs, 200, keep_first=False).collect()}
    assert spans.pop(pair["b"]) == 0 and len(spans) == 2 and all(spans.values())
