"""Near words against edit distance, counts against plain Python, blocks of any size."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from sparsetab.llm import variants

LETTERS = "abcdeéÿÀ÷"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n, times=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def vocabulary(rng, size):
    words = set()
    while len(words) < size:
        word = "".join(rng.choice(LETTERS) for _ in range(rng.randint(6, 9)))
        words.add(word)
        k = rng.randrange(len(word))
        words.add(word[:k] + rng.choice(LETTERS) + word[k:])
        words.add(word[:k] + rng.choice(LETTERS) + word[k + 1:])
    return {w: rng.choice([5, 6, 26, 150, 800, 4500]) for w in sorted(words)}


def test_group(spark):
    rng = random.Random(2)
    words = vocabulary(rng, 260) | {"é" * 3000: 9, "é" * 3001: 60, "a" * 6: 5, "a" * 7: 25}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = grouped(words)
    assert any(r[1] and r[1] != r[2] for r in want)  # some forms have forms
    for block in (2048, 40, 7):
        got = variants.group(table, block=block).collect()
        assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=repr) == want


def test_no_pair_is_missed_by_letter_counts():
    rng = random.Random(9)
    words = [w for w in vocabulary(rng, 150) if len(w) in (7, 8)]
    for size in (7, 8):
        x = [w for w in words if len(w) == 7]
        y = x if size == 7 else [w for w in words if len(w) == 8]
        a, b = (np.frombuffer("".join(w).encode("latin-1"), dtype=np.uint8).reshape(len(w), -1) for w in (x, y))
        got = set(zip(*(k.tolist() for k in variants.near(a, b, same=size == 7))))
        assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if one_edit(x[i], y[j]) and (size == 8 or i < j)}


def test_counted(spark):
    rng = random.Random(4)
    pool = ["Éclairs", "éclairs", "WORDS", "wordier", "Straße", "tooshort"[:5], "lettersÀletters", "ab÷cdef", "longword" * 200]
    rows = [(i, " -1".join(rng.choice(pool) + ("Ā" if rng.random() < 0.1 else "") for _ in range(30))) for i in range(120)]
    rows += [(None, "wordier wordier"), (3, None), (3, ""), (4, "x" * 50_000 + " 12"), (5, "wordier " * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(4)
    for changed in (0, 3):
        want = Counter()
        for i, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if changed and h % changed == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                want[run] += 1
        assert {r.word: r.n for r in variants.counted(docs, changed).collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    words = variants.counted(docs, 199)
    assert words.count() == 0 and variants.group(words).count() == 0
