"""Every stage of the pipeline against plain Python, on the smallest documents with odd rows added."""

import re
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_minhash import brute
from test_mixing import draw, reshared

import corpus_pipeline as pipeline
from sparsetab.lineage import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9000, None, "en", "src0", 0), (9001, "", None, None, 0), (9002, "12 34 !!", "en", "src1", 8), (9003, docs.orderBy("doc_id").first()["text"], None, None, None)]
    docs = cut(docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("key", F.lit(1)))
    out = []
    for _, stage in pipeline.STAGES:
        after = cut(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_are_those_dealt():
    assert [name for name, _ in pipeline.STAGES] == [
        "language ID", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_columns_pass_through(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language(stages):
    before, after = stages[0]
    gone = {r["doc_id"] for r in rows_of(before)} - {r["doc_id"] for r in rows_of(after)}
    assert gone == {9000, 9001, 9002}


def test_near_dedup(stages):
    before, after = (rows_of(x) for x in stages[1])
    groups = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, low in groups if d == low)
    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r["doc_id"] in {a["doc_id"] for a in after})


def test_substrings(stages):
    before, after = (sorted(rows_of(x), key=lambda r: r["doc_id"]) for x in stages[2])
    seen, want = set(), {}
    for r in before:  # ids are distinct here, so ids and places give the order
        words = WORD.findall(r["text"])
        gone = [False] * len(words)
        for i in range(len(words) - 34):
            window = tuple(words[i:i + 35])
            if window in seen:
                gone[i:i + 35] = [True] * 35
            seen.add(window)
        want[r["doc_id"]] = [w for w, g in zip(words, gone) if not g]
    assert {r["doc_id"]: WORD.findall(r["text"]) for r in after} == {d: w for d, w in want.items() if w}
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    assert all(r["text"] == texts[r["doc_id"]] for r in after if len(WORD.findall(texts[r["doc_id"]])) == len(want[r["doc_id"]]))


def test_mixing(spark, stages):
    before, after = (rows_of(x) for x in stages[3])
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        marks[r["doc_id"]] = 2.0 if r["quality"] >= 1 else 0.5
    want = draw([(r["doc_id"], r["source"], len(WORD.findall(r["text"])), marks.get(r["doc_id"])) for r in before])
    assert Counter(r["doc_id"] for r in after) == Counter({d: n for d, _, _, n in want if n})
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    longest = max(len(WORD.findall(r["text"])) for r in before)
    assert all(abs(taken[s] - t) <= longest / 2 + 1 for s, t in reshared(dict(sizes), (1.0, 2.0, 3.0), 3).items())


def test_encoding(stages):
    before, after = stages[4]
    rows = rows_of(after)
    assert after.columns == ["doc_id", "source", "n_pieces", "ids", "lossless"]
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in rows_of(before))
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows)


def test_repeated_and_null_ids_reach_the_end(spark):
    """A clean document with the id of another, or with none, is in the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    first = docs.orderBy("doc_id").first()
    odd = [(first["doc_id"], " ".join(f"lone{i} word" for i in range(30)), "en", first["source"], 0), (None, " ".join(f"other{i} thing" for i in range(30)), "en", first["source"], 0)]
    both = cut(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    after = pipeline.near_dedup(spark, both, SF)
    assert {t for _, t, *_ in odd} <= {r["text"] for r in after.collect()}
    after = pipeline.substring_dedup(spark, cut(after), SF)
    assert {t for _, t, *_ in odd} <= {r["text"] for r in after.collect()}


def test_run(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_pieces", "ids", "lossless"] and got.count() > 0
