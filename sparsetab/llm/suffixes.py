"""Suffix-array dedup: bytes covered by a string that occurs elsewhere are removed.

Longest-previous-factor arrays.  Suffixes that can share ``length`` bytes are brought together (``repeats``) and put in
suffix order, by prefix doubling up to ``length`` bytes, ties in order of their place in the corpus.  The longest match
of a suffix at an earlier place is with the nearest suffix of a smaller place before it in that order, or after it:
the longer of the two common prefixes is its entry.  Places in reverse give the longest match at a later place.  A
suffix whose entry reaches ``length`` begins a repeated string.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sparsetab.llm.repeats import covered, names, removed, repeated
from sparsetab.llm.tokens import RangeHash

LENGTH = 400


def nearest_smaller(v: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it with a smaller value (-1 where there is none), and their common prefix.

    ``prefix`` holds that of each entry and the one before it.  Every entry points to the one before it, and on past
    entries that are larger: what an entry has jumped over is larger than itself, so it can be jumped over by whoever is
    smaller still.  The common prefix with the entry pointed to is the least on the way.
    """
    at, least = np.arange(-1, len(v) - 1), prefix.copy()
    open_ = np.arange(len(v))
    while len(open_):
        open_ = open_[at[open_] >= 0]
        open_ = open_[v[at[open_]] > v[open_]]
        over = at[open_]
        least[open_] = np.minimum(least[open_], least[over])
        at[open_] = at[over]
    return at, least


def common_prefix(hashes: RangeHash, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Number of codes, up to ``most``, that agree from places ``a`` and ``b`` on."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
    whole = hashes.of(a, a + most) == hashes.of(b, b + most)
    low[whole] = most
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        equal = hashes.of(a[open_], a[open_] + middle) == hashes.of(b[open_], b[open_] + middle)
        low[open_] = np.where(equal, middle, low[open_])
        high[open_] = np.where(equal, high[open_], middle - 1)
    return low


def _suffix_order(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Rank of the suffix at each start by its first ``size`` codes, in a fixed order of codes."""
    kinds, at = np.unique(codes, return_inverse=True)
    if len(kinds) > 256 or size < 8:
        return names(codes, starts, size, 1)
    run = np.zeros(len(codes) - 7, dtype=np.uint64)
    for k in range(8):  # eight bytes are one number, in order
        run = (run << np.uint64(8)) | at[k:len(codes) - 7 + k].astype(np.uint64)
    return names(codes, starts, size, 8, np.unique(run, return_inverse=True)[1].astype(np.uint64))


def factors(codes: np.ndarray, starts: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest match, up to ``size`` codes, of the suffix at each start with one of an earlier, and of a later, ``place``."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rank, hashes = _suffix_order(codes, starts, size), RangeHash(codes)
    order = np.lexsort((place, rank))
    prefix = np.zeros(len(order), dtype=np.int64)
    prefix[1:] = size
    apart = 1 + np.flatnonzero(rank[order[1:]] != rank[order[:-1]])
    prefix[apart] = common_prefix(hashes, starts[order[apart - 1]], starts[order[apart]], size)
    back = np.concatenate([prefix[:1], prefix[:0:-1]])  # the same from the end
    found = []
    for value in (place[order], -place[order]):
        (before, first), (after, second) = nearest_smaller(value, prefix), nearest_smaller(value[::-1], back)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.maximum(np.where(before >= 0, first, 0), np.where(after >= 0, second, 0)[::-1])
        found.append(out)
    return found[0], found[1]


def matched(codes, starts, row, within, members, size, keep_first):
    """Which suffixes have an earlier match of ``size`` codes, or with ``keep_first`` off an earlier or a later one."""
    earlier, later = factors(codes, starts, row * (int(within.max(initial=0)) + 1) + within, size)
    return earlier >= size if keep_first else (np.maximum(earlier, later) >= size) & (members == 1)


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_column: str = "doc_id") -> DataFrame:
    """Runs of places where a repeated string begins, by document (see ``repeats.repeated``); places count bytes."""
    return repeated(docs, length, "bytes", keep_first, matched, id_column)


def dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_column: str = "doc_id") -> DataFrame:
    """Every document without the bytes that a repeated string of ``length`` bytes covers.

    Texts are UTF-8 bytes.  ``docs`` has ``id_column`` and ``text``; other columns are not read.  Returns the id,
    ``text_hash`` and ``text_key`` (of the text), ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs: first byte and length) and ``kept`` (binary).  Strings
    are judged on the input and do not cross documents.  With ``keep_first`` later copies go and the earliest (by id, hashes
    of the text, place) stays; without it every copy goes.

    A null text is empty.  Texts shorter than ``length`` lose nothing.  Rows are documents of their own even where ids
    repeat or are null; a row given twice is repeated throughout.  An empty table gives no rows.
    """

    def work(texts, runs):
        n, gone, spans, kept = [], [], [], []
        for text, own in zip(texts, runs):
            text = text or b""
            out = covered(own, len(text), length) if own else None
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).tolist() if own else []
            n.append(len(text))
            gone.append(int(out.sum()) if own else 0)
            spans.append([{"first": a, "length": b - a} for a, b in zip(edges[0::2], edges[1::2])])
            kept.append(np.frombuffer(text, dtype=np.uint8)[~out].tobytes() if own else text)
        return n, gone, spans, kept

    return removed(docs.select(id_column, F.col("text")), length, "bytes", keep_first, matched, work,
                   (("n_bytes", "bigint"), ("n_removed", "bigint"), ("spans", "array<struct<first: bigint, length: bigint>>"), ("kept", "binary")), id_column)
