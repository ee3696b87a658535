"""Runs of repeated words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) that is at least
``LEAST`` words and ``TIMES`` periods long and that no neighbouring word extends.

1. Stretches.  The words ``i`` and ``i + q`` of a run agree over at least ``GRAM`` consecutive places, so every word of
   a run lies in a gram of ``GRAM`` words that occurs twice in its document.  Words in no such gram are in no run.
2. Re-Pair over the word ids of the stretches of a batch: the pair of symbols that occurs most often becomes a rule.
   A round replaces, all at once, each pair that occurs more often than the pairs overlapping it, until no pair occurs
   twice.  What remains of a stretch is halved again and again into rules that are used once.
3. A run lies inside a derivation of some rule ``X -> A B`` and crosses the boundary of ``A`` and ``B``.  The runs that
   cross the boundary are computed once for each rule, inside its first derivation: for each period two places
   beside the boundary are extended both ways as far as words ``q`` apart agree.
4. They are translated to every position where the rule is derived.  Where the rule ends inside a run, only a piece of
   it is found; the run is found whole at a rule further up, so pieces are merged into maximal intervals by dropping
   those inside another of equal period.  Of equal intervals the least period is the run's.

Everything is arrays over a batch of documents: no step is a loop over words, rules or periods.  Rounds follow the
logarithm of the length where pairs repeat evenly.  A document is held by one task, a few hundred bytes for each word
of its stretches.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sparsetab.llm.tokens import RangeHash, mix, slices, span_hashes, words_of

LEAST, TIMES = 24, 3
GRAM = LEAST * (TIMES - 1) // TIMES  # 16: a run of period q repeats max(LEAST, TIMES q) - q >= 16 places
BATCH = 1 << 20  # bytes of text worked on at once, or one document
_CHUNK = 1 << 20  # candidates extended at once


def stretches(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a gram that occurs twice in their document; document ``d`` has words ``first[d]:first[d + 1]``."""
    n = len(codes)
    inside = np.zeros(n + 1, dtype=np.int64)
    if n >= GRAM:
        grams = RangeHash(codes).grams(GRAM)
        owner = np.searchsorted(first, np.arange(len(grams)), side="right")
        whole = np.arange(len(grams)) + GRAM <= first[np.minimum(owner, len(first) - 1)]
        place = np.flatnonzero(whole)
        _, number, count = np.unique(grams[place] + mix(owner[place].astype(np.uint64)), return_inverse=True, return_counts=True)
        twice = place[count[number] > 1]
        np.add.at(inside, twice, 1)
        np.add.at(inside, np.minimum(twice + GRAM, n), -1)
    return np.cumsum(inside[:n]) > 0


def _halved(key: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Among places whose pair equals the pair before it, every second one, counted from the first."""
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & joined[1:] & joined[:-1]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    return (np.arange(len(key)) - start) % 2 == 0


class Grammar:
    """Rules of a batch: first position, length and length of the left part, and where each is derived."""

    def __init__(self, ids: np.ndarray, word: np.ndarray, joined: np.ndarray):
        """``ids`` of words at places ``word``; ``joined[i]`` if ``i + 1`` continues the stretch of ``i``."""
        self._symbol, self._place, self._joined = ids.astype(np.int64), word.astype(np.int64), joined.copy()
        self._size = np.ones(len(ids), dtype=np.int64)
        self._next = int(ids.max()) + 1 if len(ids) else 0
        self._rules, self._uses, self._count = [], [], 0
        while len(self._symbol) and self._round():
            pass
        while self._joined.any():
            self._halve()
        empty = np.zeros(0, dtype=np.int64)
        self.first, self.size, self.left = (np.concatenate([empty, *(r[k] for r in self._rules)]) for k in range(3))
        self.rule, self.at = (np.concatenate([empty, *(u[k] for u in self._uses)]) for k in range(2))

    def _round(self) -> bool:
        """Replaces the pairs that occur most often; False if none occurs twice."""
        pair = np.flatnonzero(self._joined)
        if not len(pair):
            return False
        key = self._symbol * self._next
        key[:-1] += self._symbol[1:]
        key[~self._joined] = -1
        usable = self._joined & _halved(key, self._joined)
        kinds, number = np.unique(key[pair], return_inverse=True)
        count = np.bincount(number, weights=usable[pair]).astype(np.int64)  # overlapping ones count once
        if count.max() < 2:
            return False
        # more often first; ties by hash, so that about a third of the places of an even text are replaced in a round
        order = np.lexsort((mix(kinds.astype(np.uint64)), count))
        rank = np.empty(len(kinds), dtype=np.int64)
        rank[order] = np.arange(len(kinds))
        value = np.full(len(key) + 2, -1, dtype=np.int64)
        value[pair + 1] = rank[number]
        here = value[1:-1]
        often = np.zeros(len(key), dtype=bool)
        often[pair] = count[number] >= 2
        self._replace(np.flatnonzero(often & usable & (here >= value[:-2]) & (here >= value[2:])), here)
        return True

    def _replace(self, place: np.ndarray, name: np.ndarray) -> None:
        """Makes a rule for each name among the places, and one symbol of the two at each place."""
        kinds, first, number = np.unique(name[place], return_index=True, return_inverse=True)
        size = self._size[place] + self._size[place + 1]
        self._rules.append((self._place[place[first]], size[first], self._size[place[first]]))
        self._uses.append((self._count + number, self._place[place]))
        self._size[place] = size
        self._symbol[place] = self._next + number
        self._joined[place] = self._joined[place + 1]
        keep = np.ones(len(self._symbol), dtype=bool)
        keep[place + 1] = False
        self._symbol, self._place, self._joined, self._size = self._symbol[keep], self._place[keep], self._joined[keep], self._size[keep]
        self._next += len(kinds)
        self._count += len(kinds)

    def _halve(self) -> None:
        """Joins the symbols of each stretch two by two."""
        starts = np.ones(len(self._symbol), dtype=bool)
        starts[1:] = ~self._joined[:-1]
        place = np.arange(len(self._symbol))
        start = np.maximum.accumulate(np.where(starts, place, 0))
        self._replace(np.flatnonzero(self._joined & ((place - start) % 2 == 0)), place)


def _agreeing(hashes: RangeHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For how many places, up to ``most``, the words from ``a`` and ``b`` on agree (``back``: those before them)."""
    low, high = np.zeros(len(a), dtype=np.int64), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        x, y = (hashes.of(a - middle, a), hashes.of(b - middle, b)) if back else (hashes.of(a, a + middle), hashes.of(b, b + middle))
        equal = (x == y) & open_
        low, high = np.where(equal, middle, low), np.where(open_ & ~equal, middle - 1, high)
    return low


def crossing(codes: np.ndarray, hashes: RangeHash, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs across the boundary of each rule, inside its first derivation: rule, first word, word after the last, period."""
    long = np.flatnonzero(grammar.size >= LEAST)
    found = []
    periods = np.cumsum(grammar.size[long] // TIMES)
    at = 0
    while at < len(long):  # rules whose periods are about _CHUNK
        to = max(at + 1, int(np.searchsorted(periods, (periods[at - 1] if at else 0) + _CHUNK, side="right")))
        rule = np.repeat(long[at:to], grammar.size[long[at:to]] // TIMES)
        begin = np.concatenate([[0], np.cumsum(grammar.size[long[at:to]] // TIMES)[:-1]])
        q = np.arange(len(rule)) - np.repeat(begin, grammar.size[long[at:to]] // TIMES) + 1
        low, high = grammar.first[rule], grammar.first[rule] + grammar.size[rule]
        cut = low + grammar.left[rule]
        for anchor in (cut - q, cut - 1):  # a run that crosses holds one of these places and the place q after it
            ok = np.flatnonzero((anchor >= low) & (anchor + q < high))
            ok = ok[codes[anchor[ok]] == codes[anchor[ok] + q[ok]]]
            a, period = anchor[ok], q[ok]
            left = _agreeing(hashes, a, a + period, a - low[ok], back=True)
            right = _agreeing(hashes, a, a + period, high[ok] - a - period, back=False)
            start, end = a - left, a + right + period
            good = (end - start >= np.maximum(LEAST, TIMES * period)) & (start < cut[ok]) & (end > cut[ok])
            found.append((rule[ok][good], start[good], end[good], period[good]))
        at = to
    rule, start, end, period = (np.concatenate([np.zeros(0, dtype=np.int64), *(f[k] for f in found)]) for k in range(4))
    order = np.lexsort((period, end, start, rule))  # equal intervals: the least period
    rule, start, end, period = rule[order], start[order], end[order], period[order]
    new = np.ones(len(rule), dtype=bool)
    new[1:] = (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return rule[new], start[new], end[new], period[new]


def _translated(grammar: Grammar, rule: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """The runs of each rule at every position where it is derived."""
    order = np.argsort(grammar.rule, kind="stable")
    uses = np.bincount(grammar.rule, minlength=len(grammar.first)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(uses)])
    times = uses[rule]
    run = np.repeat(np.arange(len(rule)), times)
    turn = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    shift = grammar.at[order][begin[rule[run]] + turn] - grammar.first[rule[run]]
    return start[run] + shift, end[run] + shift, period[run]


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Intervals inside no other of equal period, and of equal ones that of least period, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    # the furthest end so far within a period: ends are lifted by period, so that one accumulation serves all
    span = int(end.max(initial=0)) + 1
    lifted = end + np.searchsorted(np.unique(period), period) * span
    most = np.maximum.accumulate(lifted)
    keep = np.ones(len(start), dtype=bool)
    keep[1:] = (lifted[1:] > most[:-1]) | (period[1:] != period[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), dtype=bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents laid end to end: first word, word after the last, period; by start, then period."""
    inside = stretches(codes, first)
    word = np.flatnonzero(inside)
    if not len(word):
        return (np.zeros(0, dtype=np.int64),) * 3
    joined = np.zeros(len(word), dtype=bool)
    joined[:-1] = word[1:] == word[:-1] + 1
    last = first[1:-1] - 1  # the last word of each document but the final one
    joined[np.isin(word, last)] = False
    grammar = Grammar(np.unique(codes[word], return_inverse=True)[1], word, joined)
    hashes = RangeHash(codes)
    return _maximal(*_translated(grammar, *crossing(codes, hashes, grammar)))


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run contains after its first period."""
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, start + period, 1)
    np.add.at(inside, end, -1)
    return np.cumsum(inside[:n]) > 0


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (an array of ``start, length, period``, by start and period) and ``collapsed`` beside the text.

    ``collapsed`` keeps of each run its first period and is joined by one space.  A null text has no words: no runs and
    an empty ``collapsed``.  Rows are independent of each other, so repeated or null ids do not matter; the names
    ``runs`` and ``collapsed`` replace columns of that name.  An empty table gives no rows.  One pass, no shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType([*kept, StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text, BATCH):
            data, a, b, first = words_of(texts)
            start, end, period = runs_of(span_hashes(data, a, b), first)
            gone = dropped(len(a), start, end, period)
            bound = np.searchsorted(start, first)
            found, short = [], []
            for d in range(len(texts)):
                own = slice(bound[d], bound[d + 1])
                found.append([{"start": int(s - first[d]), "length": int(e - s), "period": int(q)} for s, e, q in zip(start[own], end[own], period[own])])
                if found[-1]:
                    short.append(b" ".join(data[a[i]:b[i]] for i in range(first[d], first[d + 1]) if not gone[i]))
                else:
                    short.append(b" ".join((texts[d] or b"").split()))  # cuts at the same six separators
            columns = [part.column(f.name) for f in kept]
            columns += [pa.array(found, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array(short, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(work, schema)


def planted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of some documents made periodic, drawn by hash of the id.

    With ``h`` the CRC-32 of the id in decimal, ``g = h div 10`` and ``n`` words: where ``h mod 10 = 0`` and ``n > 0``,
    word ``i >= a`` becomes word ``a + (i - a) mod p`` for ``a = g mod n`` and ``p = 1 + (n - a) div (3 + g mod 8)``.
    Words of such a text are joined by one space; other texts, and those of null ids, stay.
    """
    col = lambda c: F.col(f"doc.`{c}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn(
        "h", F.crc32(col(id).cast("string").cast("binary"))).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))).withColumns(
        {"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(
        "w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select(*[F.when(F.col("a").isNotNull(), again).otherwise(col(c)).alias(c) if c == text else col(c).alias(c) for c in docs.columns])


def longest(runs: str | Column) -> Column:
    """The run of greatest length over period, ties by start, then period; null if there is none.

    Quotients are compared exactly, by cross products.
    """

    def better(best: Column, run: Column) -> Column:
        wide = lambda c: c.cast("decimal(19,0)")
        more, less = wide(run["length"]) * wide(best["period"]), wide(best["length"]) * wide(run["period"])
        return F.when(best.isNull() | (more > less), run).otherwise(best)

    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(runs, F.get(runs, F.lit(1 << 30)), better)
