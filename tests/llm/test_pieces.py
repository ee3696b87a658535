"""Encoding against the library, lossless round trips, seeded dropout."""

import numpy as np
import pytest
import sentencepiece
from conftest import SF
from hypothesis import given, settings, strategies as st

from sparsetab.llm import pieces
from sparsetab.llm.queries import VOCABULARY

ODD = ["", " ", "  a  b ", "x\ny\tz  ", "日本語テスト 🙂🙂 ok", "a" * 3000, "\x00\x01", "<s> </s> <0x0A> <unk>", "é" * 3, "ﬁ ½", "▁a ▁ b"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(VOCABULARY)


def encode(texts, vocabulary, rate=0.0, key=0):
    ids, bounds = pieces.encode_texts([t.encode() for t in texts], vocabulary, rate, np.full(len(texts), key, dtype=np.uint64))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_equals_the_library(spark, vocabulary):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD[:-1]
    assert encode(texts, vocabulary) == sentencepiece.SentencePieceProcessor(model_file=VOCABULARY).encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5), st.floats(0, 1), st.integers(0, 1 << 60))
def test_lossless(texts, rate, key):
    vocabulary = test_lossless.vocabulary = getattr(test_lossless, "vocabulary", None) or pieces.load(VOCABULARY)
    assert [pieces.decode_ids(ids, vocabulary) for ids in encode(texts + ODD, vocabulary, rate, key)] == [t.encode() for t in texts + ODD]


def test_dropout(vocabulary):
    text = ["the quick brown foxes are jumping over lazy dogs " * 20]
    plain, some = encode(text, vocabulary), encode(text, vocabulary, 0.1, 1)
    assert some == encode(text, vocabulary, 0.1, 1) and some != encode(text, vocabulary, 0.1, 2) and some != plain
    assert len(plain[0]) < len(some[0]) < len(encode(text, vocabulary, 0.6, 1)[0]) < len(encode(text, vocabulary, 1.0, 1)[0])
    assert encode(text, vocabulary, 1.0, 1)[0] == [vocabulary.chars[ord(c)] for c in " " + text[0]]


def test_every_occurrence_is_drawn(spark, vocabulary):
    """One word has many cuts within a document and across more than eight of them, and copies of a document differ."""
    text = " ".join(["international"] * 200)
    cuts = lambda ids: {tuple(w) for w in np.split(ids, np.flatnonzero([vocabulary.texts[i].startswith(b" ") for i in ids]))[1:]}
    ids, _ = pieces.encode_texts([text.encode()], vocabulary, 0.3, np.zeros(1, dtype=np.uint64))
    assert len(cuts(ids)) > 8
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(0, text), (0, text), (None, text), (None, text)], "doc_id long, text string")
    got = [tuple(r["ids"]) for r in pieces.encode(docs, vocabulary, rate=0.1, seed=1).collect()]
    assert len(set(got)) == 7
    assert sorted(got) == sorted(tuple(r["ids"]) for r in pieces.encode(docs.repartition(5), vocabulary, rate=0.1, seed=1).collect())


def test_plain_agendas_change_nothing(vocabulary):
    """Units that take the shared result have what their own agenda gives."""
    text = ("the quick brown foxes are jumping over lazy dogs " * 40).encode()
    shared, _ = pieces.encode_texts([text], vocabulary, 0.1, np.full(1, 9, dtype=np.uint64))
    words, out = (b" " + text).split(b" ")[1:], []
    keys = pieces.mix(np.repeat(pieces.mix(np.full(1, 9, dtype=np.uint64)), len(words)) ^ pieces.mix(np.arange(len(words)).astype(np.uint64)))
    for word, key in zip(words, keys):
        sym = pieces._symbols(vocabulary, np.frombuffer((" " + word.decode()).encode("utf-32-le"), dtype=np.uint32))[None, :]
        left, at = pieces._work_off(vocabulary, sym, key[None], 0.1)
        out += left[at[:, 1:] >= 0].tolist()
    assert shared.tolist() == out


def test_frames(spark, vocabulary):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(90, None, 7), (None, "no id", 7), (1, "same id", 7), (3, ODD[3], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = pieces.encode(docs, vocabulary, rate=0.3, seed=5, check=True)
    assert all(r["lossless"] for r in encoded.collect())
    again = pieces.encode(docs.repartition(3), vocabulary, rate=0.3, seed=5)
    assert sorted(map(repr, (tuple(r) for r in again.collect()))) == sorted(map(repr, (tuple(r) for r in encoded.drop("lossless").collect())))
    back = pieces.decode(encoded.drop("lossless"), vocabulary)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def agenda(vocabulary, text, key, rate):
    """One unit, candidate by candidate: of all pairs not skipped the best rank, leftmost first."""
    word = pieces._WORD
    symbols, merges = [(vocabulary.chars.get(ord(c), -1), i) for i, c in enumerate(text)], vocabulary.merges()
    while True:
        best = None
        for i, ((x, a), (y, m)) in enumerate(zip(symbols, symbols[1:])):
            b = symbols[i + 2][1] if i + 2 < len(symbols) else len(text)
            found = merges.get(x << 32 | y) if x >= 0 and y >= 0 else None
            if found and pieces._mixed((key ^ pieces._mixed(a << 42 ^ m << 21 ^ b)) & word) / 2.0 ** 64 >= rate and (best is None or (found[0], a) < best[:2]):
                best = (found[0], a, i, found[1])
        if best is None:
            return symbols
        symbols[best[2]:best[2] + 2] = [(best[3], best[1])]


def spelled(vocabulary, text, symbols):
    out = []
    for (s, a), b in zip(symbols, [a for _, a in symbols[1:]] + [len(text)]):
        out += [s] if 0 <= s < len(vocabulary.texts) else [int(vocabulary.byte_ids[x]) for x in text[a:b].encode()]
    return out


def test_dropout_equals_a_plain_agenda(spark, vocabulary):
    """At the rate of the query, whole documents of the table, unit by unit."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).select("text").collect()]
    texts = [t[:6000] for t in texts] + ODD + ["x" * 700 + " the " + "international" * 60]
    got = encode(texts, vocabulary, 0.1, 77)
    for text, ids in zip(texts, got):
        padded, want = " " + text if text else "", []
        starts = [i for i, c in enumerate(padded) if c == " " and (i == 0 or padded[i - 1] != " ")]
        for place, (a, b) in enumerate(zip(starts, starts[1:] + [len(padded)])):
            key = pieces._mixed(pieces._mixed(77) ^ pieces._mixed(place))
            want += spelled(vocabulary, padded[a:b], agenda(vocabulary, padded[a:b], key, 0.1))
        assert ids == want


def test_long_units(vocabulary):
    """A heap gives what agendas side by side give, and a text of a million characters without a space is done."""
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß\U0001F642") for _ in range(400))
    sym = pieces._symbols(vocabulary, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    for rate, key in ((0.0, 0), (0.1, 5), (0.5, 9)):
        left, at = pieces._work_off(vocabulary, sym[None, :], np.full(1, key, dtype=np.uint64), rate)
        symbols, places = pieces._work_off_long(vocabulary, sym, key, rate, None)
        kept = at[0, 1:] >= 0
        assert symbols.tolist() == left[0, kept].tolist() and places[:-1].tolist() == at[0, :-1][kept].tolist()
    whole = "".join(rng.choice(["inter", "nation", "al", "ly", "q"]) for _ in range(300_000))
    ids = encode([whole], vocabulary, 0.1, 3)[0]
    assert pieces.decode_ids(ids, vocabulary).decode() == whole


def test_rows_repeated_many_times(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "COPIES", 7)
    rows = [(None, "electricity and magnetism", 1)] * 50 + [(1, "electricity and magnetism", 2), (1, "electricity and magnetism", 3), (2, None, 1), (2, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = [[(r["doc_id"], r["n"], r["ids"] and tuple(r["ids"])) for r in pieces.encode(docs.repartition(n), vocabulary, rate=0.4, seed=2).collect()] for n in (1, 6)]
    assert sorted(got[0], key=repr) == sorted(got[1], key=repr) and len(got[0]) == len(rows)
    assert len({ids for i, _, ids in got[0] if i is None}) > 20 and [x[2] for x in got[0] if x[0] == 2] == [None, None]
