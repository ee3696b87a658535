"""Spelling variants of the words of a corpus, by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  Such an edit changes the
counts of letters by at most two: the squared distance of the count vectors is 1 for an insertion, and 2 or 0 for a
replacement.  So words of equal length, and words of lengths that differ by one, are compared block by block: the Gram
matrix ``X Y'`` of two blocks of count vectors, one NumPy product, gives all squared distances ``|x|^2 + |y|^2 - 2 x.y``;
pairs at most two apart are verified letter by letter.

Words of one length are dealt into blocks by hash.  Block ``i`` of ``T`` of one length is paired with the block ``d``
places further on, ``d <= T / 2``; blocks of adjacent lengths are paired all with all.  A pair of blocks is one row of
work with a key of its own, so the work is even whatever the lengths are.  It grows with the square of the vocabulary,
not of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.lineage import cut, cut_count

RUN = r"([a-zÀ-ÿ]{6,})"
SHORTEST, RAREST = 6, 5  # code points of a word, and occurrences
BLOCK = 2048  # words of a block
BLOCK_LETTERS = 1 << 17  # letters of a block, which bounds blocks of very long words
_PAIR_LETTERS = 1 << 22  # letters of candidate pairs verified at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = np.full(256, -1)
_LETTERS[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(26 + 64)


def counted(docs: DataFrame, changed: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words with their number of occurrences: ``word, n``, for words of ``SHORTEST`` code points and ``RAREST`` occurrences or more.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF in whole texts; only A to Z are lower-cased.  With
    ``changed``, a word of a document loses one letter where ``changed`` divides ``h``, the CRC-32 of ``id:word``: that at
    place ``h mod length``.  A null id counts as empty there, a null text has no words.  Other columns are ignored.
    Occurrences are pre-aggregated in each task, so a word said by a third of all documents is a row for each task.
    """
    rows = docs.select(F.col(f"`{id}`").cast("string").alias("id"), F.explode(
        F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _LOWER), F.lit(RUN), F.lit(1))).alias("run"))
    word = F.col("run")
    if changed:
        rows = rows.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")))
        place = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % changed == 0, F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))).otherwise(word)
    words = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.length("word") >= SHORTEST) & (F.col("n") >= RAREST))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block; the words of a block come one after another."""
    key, own = None, []

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int64()) for k in key] + [pa.array([b"".join(w.encode("latin-1") for w, _ in own)], pa.binary()),
             pa.array([np.array([n for _, n in own], dtype=np.int64).tobytes()], pa.binary())], ["size", "blocks", "block", "words", "counts"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("size", "blocks", "block", "word", "n")]
        for size, blocks, block, *word in zip(*columns):
            if (size, blocks, block) != key:
                if own:
                    yield row()
                key, own = (size, blocks, block), []
            own.append(word)
    if own:
        yield row()


def letter_counts(words: np.ndarray) -> np.ndarray:
    """How often each letter is in each of ``words`` (code points, a row for each word)."""
    kinds = _LETTERS.max() + 1
    at = _LETTERS[words] + kinds * np.arange(len(words))[:, None]
    return np.bincount(at.ravel(), minlength=kinds * len(words)).reshape(len(words), kinds)


def _candidates(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose count vectors are at most two apart (squared).

    The product runs over the letters both blocks have, and over two more columns that add the squared lengths.
    """
    kind = np.float32 if max(x.shape[1], y.shape[1]) < 1024 else np.float64  # sums of whole numbers without rounding
    a, b = letter_counts(x), letter_counts(y)
    both = a.any(axis=0) & b.any(axis=0)
    one = np.ones((len(a), 1)), np.ones((len(b), 1))
    left = np.hstack([a[:, both], (a * a).sum(axis=1, keepdims=True), one[0]]).astype(kind)
    right = np.hstack([-2 * b[:, both], one[1], (b * b).sum(axis=1, keepdims=True)]).astype(kind)
    i, j = np.nonzero(left @ right.T <= 2)
    return (i[i < j], j[i < j]) if same else (i, j)


def near(x: np.ndarray, y: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all near pairs of two blocks; ``y`` has words as long as those of ``x`` or one longer.

    ``same``: both are one block, pairs i < j.
    """
    i, j = _candidates(x, y, same)
    step = max(1, _PAIR_LETTERS // max(1, y.shape[1]))
    keep = [np.zeros(0, dtype=bool)]
    for k in range(0, len(i), step):
        a, b = x[i[k:k + step]], y[j[k:k + step]]
        if a.shape[1] == b.shape[1]:
            keep.append((a != b).sum(axis=1) == 1)
        else:  # equal up to some place, and from there on with b moved by one
            before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
            after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            keep.append(before + after >= a.shape[1])
    kept = np.concatenate(keep)
    return i[kept], j[kept]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of a pair of blocks, each pair both ways."""
    for batch in batches:
        for r in batch.to_pylist():
            x, y = (np.frombuffer(r[s]["words"], dtype=np.uint8).reshape(-1, r[s]["size"]) for s in "ab")
            n, m = (np.frombuffer(r[s]["counts"], dtype=np.int64) for s in "ab")
            i, j = near(x, y, r["same"])
            left, right = ([row.tobytes().decode("latin-1") for row in w] for w in (x[i], y[j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(left + right, pa.string()), pa.array(right + left, pa.string()), pa.array(np.concatenate([m[j], n[i]]), pa.int64())], ["word", "other", "n"])


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """All near pairs of ``words(word, n)``, both ways: ``word, other, n`` with the number of the other."""
    sized = words.withColumn("size", F.length("word").cast("long"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(BLOCK_LETTERS / F.col("_size"))))
    blocks = sized.groupBy(F.col("size").alias("_size")).agg(F.count("*").alias("_words")).select(
        "_size", F.ceil(F.col("_words") / per_block).alias("blocks"))
    dealt = sized.join(blocks, F.col("size") == F.col("_size")).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    packed = cut(dealt.select("size", "blocks", "block", "word", "n").repartition("size", "block").sortWithinPartitions("size", "block", "word").mapInArrow(
        _packed, "size long, blocks long, block long, words binary, counts binary"))
    here = F.struct("size", "words", "counts")
    further = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("blocks") / 2)), lambda d: F.struct(
        F.lit(0).alias("longer"), F.col("size").alias("size"), F.col("block").alias("i"), F.pmod(F.col("block") + d, F.col("blocks")).alias("j"), d.alias("d")))
    # half of an even number of places on, a pair would be met from both its blocks
    once = F.filter(further, lambda k: (2 * k["d"] != F.col("blocks")) | (k["d"] == 0) | (k["i"] < k["j"]))
    key = ["longer", "size", "i", "j"]
    own = [F.col(f"_k.{c}").alias(c) for c in key]
    first = packed.select(F.explode(once).alias("_k"), here.alias("a")).select(*own, "a")
    back = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("blocks") / 2)), lambda d: F.struct(
        F.lit(0).alias("longer"), F.col("size").alias("size"), F.pmod(F.col("block") - d, F.col("blocks")).alias("i"), F.col("block").alias("j")))
    second = packed.select(F.explode(F.array_distinct(back)).alias("_k"), here.alias("b")).select(*own, "b")

    counts = packed.select("size", "blocks").distinct()
    up = packed.join(counts.select((F.col("size") - 1).alias("size"), F.col("blocks").alias("_others")), "size")
    down = packed.join(counts.select((F.col("size") + 1).alias("size"), F.col("blocks").alias("_others")), "size")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_others") - 1))
    shorter = up.withColumn("j", others).select(F.lit(1).alias("longer"), "size", F.col("block").alias("i"), "j", here.alias("a"))
    longer = down.withColumn("i", others).select(F.lit(1).alias("longer"), (F.col("size") - 1).alias("size"), "i", F.col("block").alias("j"), here.alias("b"))
    pairs = first.unionByName(shorter).join(second.unionByName(longer), key)
    same = (F.col("longer") == 0) & (F.col("i") == F.col("j"))
    return pairs.select(same.alias("same"), "a", "b").mapInArrow(_compare, "word string, other string, n long")


def group(words: DataFrame, times: int = 5, block: int = BLOCK) -> DataFrame:
    """The usual form of each of ``words(word, n)``: ``word, n, form, form_n, n_near, root``.

    ``form`` is the near word that occurs most often (ties: the smallest), if it occurs ``times`` times as often as the
    word or more, else null; ``root`` is reached from the word by forms.  Forms occur ever more often, so there are no
    cycles, and pointers are doubled until all have arrived: a handful of rounds.  Words are distinct and made of the
    letters named above; an empty table gives no rows.
    """
    words = cut(words.select("word", "n"))
    best = near_pairs(words, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    usual = -F.col("best.less") >= times * F.col("n")
    found = cut(words.join(best, "word", "left").select(
        "word", "n", F.when(usual, F.col("best.other")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")))
    pointers, moved = cut_count(found.select("word", F.coalesce("form", "word").alias("root")), "root <> word")
    while moved:
        above = pointers.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("_up"))
        pointers, moved = cut_count(
            pointers.join(above, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "moved")
        pointers = pointers.drop("moved")
    return found.join(pointers, "word")
