"""Runs against a search over all periods; planting and the query's columns against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from conftest import SF

from sparsetab.llm import periodic, queries
from sparsetab.llm.tokens import span_hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def searched(words):
    """Every run as (start, length, period): maximal stretches for each period, the least period of equal ones."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng, n):
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            base = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
            words += (base * rng.randint(1, 30))[:rng.randint(1, 200)] + [str(rng.randrange(100)) for _ in range(rng.randint(0, 10))]
        yield words


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_a_batch():
    rng = random.Random(3)
    for _ in range(60):
        docs = [*texts(rng, rng.randint(1, 5)), []]
        data, a, b, first = words_of([" ".join(d).encode() for d in docs])
        start, end, period = periodic.runs_of(span_hashes(data, a, b), first)
        for d, words in enumerate(docs):
            own = (start >= first[d]) & (start < first[d + 1])
            assert list(zip((start[own] - first[d]).tolist(), (end - start)[own].tolist(), period[own].tolist())) == searched(words)


def test_rules_derive_the_text():
    """Every use of a rule spells the same words."""
    rng = random.Random(5)
    words = [str(rng.randrange(3)) for _ in range(400)]
    ids = np.unique(words, return_inverse=True)[1]
    joined = np.ones(400, dtype=bool)
    joined[[149, 399]] = False
    grammar = periodic.Grammar(ids, np.arange(400), joined)
    assert (np.bincount(grammar.rule) >= 1).all() and (grammar.left > 0).all() and (grammar.left < grammar.size).all()
    for rule, at in zip(grammar.rule, grammar.at):
        first, size = grammar.first[rule], grammar.size[rule]
        assert words[first:first + size] == words[at:at + size]
    assert {150, 250} <= set(grammar.size.tolist())  # a rule for each stretch as a whole


def test_long_texts():
    for words, want in ((["x"] * 300_000, [(0, 300_000, 1)]), ([str(i % 997) for i in range(100_000)], [(0, 100_000, 997)]), ([str(i) for i in range(50_000)], [])):
        data, a, b, first = words_of([" ".join(words).encode()])
        start, end, period = periodic.runs_of(span_hashes(data, a, b), first)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want


def test_collapse(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "\t ".join(words)) for i, words in enumerate(texts(rng, 40))]
    rows += [(None, None), (100, ""), (100, " \n"), (101, "one"), (101, "é " * 30 + " "), (None, "a b " * 12)]
    docs = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, runs string, start int")
    for size in (1 << 20, 500):
        monkeypatch.setattr(periodic, "BATCH", size)
        got = periodic.collapse(docs.repartition(3))
        assert got.columns == ["doc_id", "text", "start", "runs", "collapsed"]
        have = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
        words = {t: WORD.findall(t or "") for _, t in rows}
        assert have == sorted(((i, t, searched(words[t]), collapsed(words[t], searched(words[t]))) for i, t in rows), key=repr)
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_planted(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 90))) for i in range(300)] + [(None, "stays as  it is"), (10, None), (27, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    got = sorted(((r.doc_id, r.text) for r in periodic.planted(docs).collect()), key=repr)
    want, changed = [], 0
    for i, text in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words, g = WORD.findall(text or ""), h // 10
        if h % 10 == 0 and words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text, changed = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n)), changed + 1
        want.append((i, text))
    assert got == sorted(want, key=repr) and changed > 10


def test_query(spark):
    """Whole documents of the table, each word of the contract computed plainly."""
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    rows = periodic.planted(queries.table(spark, SF, "documents").select("doc_id", "text")).collect()
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 5
    for row in rows:
        words, r = WORD.findall(row.text or ""), got[row.doc_id]
        runs = searched(words) if len(words) < 3000 or r.n_runs else []
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
