"""MinHash near-dedup against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparsetab.llm import minhash
from sparsetab.llm.linking import components


def sets_of(text, k):
    words = (text or "").lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(5000)}"
    rows = []
    for _ in range(6):  # families of near copies, each a few changes from the next
        text = [word() for _ in range(draw.randrange(60, 200))]
        for _ in range(draw.randrange(2, 25)):
            if draw.random() < 0.7:
                text = list(text)
                text[draw.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    shared = " ".join(word() for _ in range(40))  # a passage that many share without being near copies
    rows += [(len(rows) + i, shared + " " + " ".join(word() for _ in range(60))) for i in range(40)]
    short = [("a", "A b"), ("b", "a B"), ("c", "a"), ("d", "a b c d e f g h i j k l"), ("e", "a b c d e f g h i j k l m")]
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(short)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (None, "quite alone here"), (3, "another text of id three"), rows[5]]


def test_against_all_pairs(spark):
    for seed, k, percent in ((1, 2, 80), (2, 5, 80), (3, 3, 50)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, n long, set binary")
        got = minhash.near_duplicates(docs, k, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, k, percent)
        assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_pieces_of_a_centre_and_stragglers(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 3)
    rows = corpus(4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, 2, 80)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "A b c d e f", "y"), (5, "other words of another text", None), (6, None, "z")]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert sorted((r["doc_id"], r["kept"]) for r in kept.collect()) == [(1, "x"), (5, None), (6, "z")]
    assert minhash.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_repeated_id_and_null_ids_stay(spark):
    """Unrelated texts of one id are groups of their own, and so is a document without an id."""
    rows = [(3, "a b c d e f", "x"), (3, "other words of another text", "y"), (3, "A b c d e f", "z"), (None, "quite alone here it is", "n"),
            (None, "a b c D e f", "gone"), (None, "twice the same without id", "t"), (None, "twice the same without id", "t"), (None, None, "0"),
            (4, "", "e"), (4, None, "f")]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()
    marks = sorted(r["mark"] for r in kept)
    assert marks in (sorted("xyntef0"), sorted("zyntef0")) and len({(r["doc_id"], r["text"]) for r in kept}) == len(kept)


def test_signatures():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
    near = np.unique(np.concatenate([base[20:], draw.integers(0, 1 << 63, 20).astype(np.uint64)]))
    tiny = base[:1]
    a, b, c = minhash.signatures([base, near, tiny])
    want = len(np.intersect1d(base, near)) / len(np.union1d(base, near))
    assert abs((a == b).mean() - want) < 0.08 and (c == tiny[0]).all()
    assert (minhash.signatures([base])[0] == a).all()
    assert (minhash.signatures([base[:5]])[0] == minhash.signatures([tiny, base[:5]])[1]).all()


def test_components(spark):
    draw = random.Random(9)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(500 + i, 500 + i + 1) for i in range(40)] + [(700, i) for i in range(701, 760)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        return a if root[a] == a else find(root[a])

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {a: find(a) for a in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").count() == 0
