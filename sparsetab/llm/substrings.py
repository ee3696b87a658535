"""Substring dedup: words covered by a window that occurs elsewhere are removed.

Prefix-partitioned suffix trees.  Suffixes are grouped by a prefix of their window (``repeats``); groups that fit a
task become subtrees here, others are split by longer prefixes there.  A subtree is descended from its root, the
edges being blocks of words: suffixes with the same block stay together, one alone is a leaf and goes.  Suffixes
still together at the depth of a whole window meet in a deep internal node, which is a repeat; neighbouring ones join
to maximal repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sparsetab.llm.repeats import covered, removed, repeated
from sparsetab.llm.tokens import words_of

WINDOW = 35


def deep_nodes(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node at ``depth`` that each suffix hangs from, -1 where it is alone there.

    Names of blocks of 1, 2, 4, ... words are made once, a block from its two halves; the descent takes the blocks
    that add up to ``depth``, longest first.
    """
    blocks = [np.unique(codes, return_inverse=True)[1].astype(np.uint64)]
    while 2 << (len(blocks) - 1) <= depth:
        half = 1 << (len(blocks) - 1)
        last = blocks[-1]
        pair = (last[:-half] << np.uint64(32)) | last[half:] if len(last) > half else np.zeros(0, dtype=np.uint64)
        blocks.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
    node, alive, down = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts)), 0
    for level in reversed(range(len(blocks))):
        if depth & (1 << level) and len(alive):
            edge = (node[alive].astype(np.uint64) << np.uint64(32)) | blocks[level][starts[alive] + down]
            _, at, count = np.unique(edge, return_inverse=True, return_counts=True)
            node[alive] = np.where(count[at] > 1, at, -1)
            alive = alive[count[at] > 1]
            down += 1 << level
    return node


def subtree(codes, starts, row, within, members, size, keep_first):
    """Which suffixes hang from a deep node; with ``keep_first``, all of them but the first of each node."""
    node = deep_nodes(codes, starts, size)
    if not keep_first:
        return (node >= 0) & (members == 1)
    order = np.lexsort((within, row, node))
    later = np.zeros(len(node), dtype=bool)
    later[order[1:]] = node[order[1:]] == node[order[:-1]]
    return later & (node >= 0)


def repeats(docs: DataFrame, window: int = WINDOW, keep_first: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Runs of repeated windows by document (see ``repeats.repeated``); places count words."""
    return repeated(docs, window, "words", keep_first, subtree, id_column)


def dedup(docs: DataFrame, window: int = WINDOW, keep_first: bool = False, layout: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Every document without the words that a repeated window covers.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  ``docs`` has ``id_column`` and ``text``; other columns
    are not read.  Returns the id, ``text_hash`` and ``text_key`` (of the input), ``n_words``, ``n_removed`` and ``text``, the kept words joined by one space; with
    ``layout``, the text as it was, each removed word taken out with the white space after it.  Windows are judged on the
    input.  With ``keep_first``, the earliest occurrence of a window (by id, hashes of the text, place) stays.

    A null text has no words and stays null under ``layout``, else becomes empty.  Texts with fewer words than a window
    lose nothing.  Rows are documents of their own even where ids repeat or are null; a row given twice is repeated
    throughout.  An empty table gives no rows.
    """

    def work(texts, runs):
        n, gone, kept = [], [], []
        for text, own in zip(texts, runs):
            data, starts, ends, _ = words_of([text])
            out = covered(own, len(starts), window)
            n.append(len(starts))
            gone.append(int(out.sum()))
            if layout:
                kept.append(text if not gone[-1] else _cut_out(text, starts, out))
            else:
                kept.append(b" ".join([data[a:b] for a, b in zip(starts[~out].tolist(), ends[~out].tolist())]))
        return n, gone, [None if k is None else k.decode("utf-8", "replace") for k in kept]

    return removed(docs.select(id_column, F.col("text")), window, "words", keep_first, subtree, work,
                   (("n_words", "bigint"), ("n_removed", "bigint"), ("text", "string")), id_column)


def _cut_out(text: bytes, starts: np.ndarray, out: np.ndarray) -> bytes:
    bounds = np.append(starts, len(text))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))
    parts = [text[:bounds[0]]]
    for a, b in zip(edges[0::2], edges[1::2]):
        parts.append(text[bounds[a]:bounds[b]])
    return b"".join(parts)
