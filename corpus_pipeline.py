"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

1. Language ID: documents without a letter go, and those whose language the model cannot tell (a score below
   ``LEAST_SCORE``; with four languages, chance gives 0.25).
2. MinHash near-dedup on runs of five words at a similarity of 0.8: one document of each group stays.
3. Substring dedup: of windows of 35 words that occur more than once the earliest stays; documents of which no word
   is left go.
4. Mixing: sources to target weights; a document is repeated as often as the mix takes it.
5. SentencePiece encoding with merge-dropout, and decoding to make sure that nothing is lost.

Null texts go in stage 1.  Rows that repeat an id are documents of their own up to stage 2, which keeps one of rows
equal in id and text.  Columns beside those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparsetab.lineage import clear, cut, folder
from sparsetab.llm import language, minhash, mixing, pieces, queries, substrings

LEAST_SCORE = 0.35

#: The stages train models, link documents over rounds and draw by hash in them: SQL cannot say it.
ORACLE_SQL = None


_spent: list[str] = []


def stage(function):
    """A stage with a folder for its intermediate tables, which is deleted when the next stage begins.

    By then the stage's result has been written and is read from there.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _spent:
            clear(spark, _spent.pop())
        _spent.append(f"stage-{uuid.uuid4().hex}")
        with folder(_spent[-1]):
            return function(spark, docs, sf_dir)

    return run_stage


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with 96 bits of hashes of their text; with the id, these tell documents apart."""
    return docs.withColumns({"_hash": F.hash("text"), "_key64": F.xxhash64("text")})


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")) & (F.col("_key64") == F.col("_x"))


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.spoken(spark, docs)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    known = language.predict(rows, model, keep_text=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; ``n_chars`` follows the text."""
    left = substrings.dedup(docs, keep_first=True, layout=True).where(F.col("n_words") > F.col("n_removed")).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("text_key").alias("_x"), F.col("text").alias("_text")).dropDuplicates(["_id", "_h", "_x"])
    joined = _keyed(docs).drop("text").join(left, _same_document())
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; good ones (by ``labels``) come first more often."""
    weights = queries.quality_weights(queries.table(spark, sf_dir, "labels"))
    sized = docs.select(F.col("doc_id").alias("row"), F.hash("text").alias("_h"), F.xxhash64("text").alias("_x"), "source", mixing.n_words("text").alias("size"))
    sized = sized.join(weights, F.col("row") == F.col("_labelled"), "left")
    taken = mixing.mix(sized, carry=("_h", "_x"), tie="_x").where(F.col("copies") > 0).select(
        F.col("row").alias("_id"), "_h", "_x", "copies").dropDuplicates(["_id", "_h", "_x"])
    rows = _keyed(docs).join(taken, _same_document())
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_pieces, ids, lossless``."""
    return queries.encoded(docs.select("doc_id", "source", "text"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = cut(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
