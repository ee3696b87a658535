"""Language, quality and toxicity models: gradients, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsetab.llm import language, quality, samples, toxicity
from sparsetab.llm.ftrl import Ftrl, sigmoid

SF = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n"), (4, "1234 !!"), (5, "the cat " * 20000), (6, "x" * 5000), (None, "the and of"), (7, "the and of"), (7, "the and of")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def speaker(docs):
    return language.fit(docs, ~samples.held_out("doc_id", 4, 2))


def test_gradient_of_the_network():
    model = language.Model(["a", "b", "c"], units=3, seed=3)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    codes, y = np.array([[1, 2, 0, 5], [7, 1, 1, 0]]), np.array([0, 2])

    def loss():
        p = np.log(language.label_words(model, codes))
        letters = codes > 0
        return -sum(p[i, t, y[i]] for i in range(2) for t in range(4) if letters[i, t]) / letters.sum()

    grads = language._gradients(model, codes, y)
    for name, part in model.parts.items():
        for at in list(np.ndindex(part.shape))[::max(1, part.size // 40)]:
            old = part[at]
            part[at] = old + 1e-4
            up = loss()
            part[at] = old - 1e-4
            down = loss()
            part[at] = old
            assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3, (name, at)


def test_language_of_held_out_documents(docs, speaker):
    got = language.predict(docs.select("doc_id", "lang", "text"), speaker).where(samples.held_out("doc_id", 4, 2))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edge_cases(spark, speaker):
    rows = spark.createDataFrame([(*r, 0.5, "q") for r in EDGE], "doc_id long, text string, score double, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(rows, speaker).collect()]
    assert len(got) == len(EDGE)
    assert all((lang, score) == ("und", 0.0) for i, lang, score in got if i in (1, 2, 3, 4))
    assert all(lang in speaker.languages and 0 < score <= 1 for i, lang, score in got if i in (5, 6, 7, None))
    nothing = language.fit(spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(rows, nothing).collect()} == {"und"}
    assert language.predict(rows.limit(0), speaker).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    """A text said thousands of times speaks once, so the sample is that of the distinct texts."""
    texts = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(40)]
    once = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    often = once.unionByName(spark.createDataFrame([(texts[0], "en")], once.schema).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    drawn = lambda docs: sorted(r["word"] for r in language.samples(docs, F.lit(True), 300, 200).collect())
    assert len(set(drawn(often))) == 200 and drawn(often) == drawn(once)


def test_labels_of_positions(docs, speaker):
    row = docs.where("lang = 'de' AND length(text) > 300").select("text").first()
    text = row["text"].encode()
    got = language.positions(text, speaker)
    assert len(got) == len(text) and all((x is None) == (text[i] in b" \t\n\r\x0b\x0c") for i, x in enumerate(got))
    spoken = [x for x in got if x]
    assert spoken.count("de") > 0.5 * len(spoken)
    assert language.positions(b"", speaker) == []


def accuracy(scored, labels, target, folds, out, at):
    rows = scored.join(labels.where(F.col(target).isNotNull()), "doc_id").where(samples.held_out("doc_id", folds, out))
    return rows.agg(F.avg(((F.col("score") >= at) == (F.col(target) == 1)).cast("int"))).first()[0]


def test_quality(spark, docs, labels):
    weights = quality.fit(samples.labelled(docs, labels, "quality", 4, 2, quality.ROWS))
    assert accuracy(quality.score(docs.select("doc_id", "text"), weights), labels, "quality", 4, 2, 0.7) > 0.95
    rows = spark.createDataFrame([(*r, 9) for r in EDGE], "doc_id long, text string, score int")
    got = quality.score(rows, weights).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    none = quality.fit(samples.labelled(docs, labels.limit(0), "quality", 4, 2, 10))
    assert {r["score"] for r in quality.score(rows, none).collect()} == {0.5}


def test_toxicity(spark, docs, labels):
    weights = toxicity.fit(samples.labelled(docs, labels, "toxic", 5, 0, toxicity.ROWS))
    assert accuracy(toxicity.score(docs.select("doc_id", "text"), weights), labels, "toxic", 5, 0, 0.5) > 0.9
    rows = spark.createDataFrame([(*r, 9) for r in EDGE], "doc_id long, text string, score int")
    got = toxicity.score(rows, weights).collect()
    assert len(got) == len(EDGE) and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert toxicity.score(rows.limit(0), weights).count() == 0


def test_offending_sentences(spark):
    clean = ["the cat sat", "a dog ran on", "we eat fish", "it rains on the sea"]
    rows = [(i, ". ".join(clean[(i + j) % 4] for j in range(3)) + (". you are a grobnik!" if i % 3 == 0 else ".") + " the end", float(i % 3 == 0)) for i in range(90)]
    weights = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y double"))
    docs = spark.createDataFrame([(1, "It rains. Grobnik you are. We eat."), (2, "we eat fish."), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["sentence"], r["at"]) for r in toxicity.offending(docs, weights).collect()] == [(1, "Grobnik you are.", 9)]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    assert scores[1] > 0.5 > 0.1 > scores[2] and scores[3] == 0


def test_sample_is_bounded_and_keeps_to_its_folds(spark, docs, labels):
    rows = samples.labelled(docs, labels, "quality", 4, 2, 50)
    assert rows.count() == 50 and rows.where(samples.held_out("doc_id", 4, 2)).count() == 0
    twice = labels.unionByName(labels)
    assert samples.labelled(docs, twice, "quality", 4, 2, 50).select("doc_id").exceptAll(rows.select("doc_id")).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert samples.labelled(docs, odd, "quality", 4, 2, 50).count() == 0


def test_a_labelled_id_counts_once(spark):
    docs = spark.createDataFrame([(1, f"text {i:03}") for i in range(300)] + [(i, "x") for i in range(2, 9)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    rows = samples.labelled(docs, marks, "quality", 4, 9, 100)
    assert rows.count() == 8 and rows.where("doc_id = 1").first()["text"] == "text 000"


def test_long_words_are_pieces(spark):
    text = "ab" * 100 + " " + "語" * 25 + " short"
    drawn = sorted(r["word"] for r in language.samples(spark.createDataFrame([(text, "en")], "text string, lang string"), F.lit(True)).collect())
    assert drawn == sorted(["ab" * 16] * 6 + ["ab" * 4, "語" * 10, "語" * 10, "語" * 5, "short"])
    model = language.train([(w.encode(), 0) for w in drawn], ["en"], epochs=1)
    assert model.languages == ["en"]


def test_a_language_with_many_documents(spark):
    """The least hashes are drawn, however many there are."""
    docs = spark.range(3000).select(F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    least = sorted(r[0] for r in docs.orderBy(F.xxhash64("text")).limit(70).select("text").collect())
    assert sorted(r["word"] for r in language.samples(docs, F.lit(True), 70, 500).collect()) == least


def test_ftrl_learns_a_line():
    draw = np.random.default_rng(0)
    model = Ftrl(4, alpha=0.5, l1=0.0, l2=0.0)
    idx = np.arange(4)
    for _ in range(4000):
        x = np.array([1.0, *draw.normal(size=3)])
        y = float(draw.random() < sigmoid(x @ np.array([0.5, 2.0, -1.0, 0.0])))
        w = model.at(idx)
        model.update(idx, w, (sigmoid(w @ x) - y) * x)
    assert np.abs(model.weights() - np.array([0.5, 2.0, -1.0, 0.0])).max() < 0.4
