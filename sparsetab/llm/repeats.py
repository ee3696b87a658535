"""Windows of tokens that occur more than once in a corpus, exactly, without moving every suffix.

Tokens are words or bytes; a window is ``size`` consecutive tokens of one document.  Every window has an anchor: the
gram of ``size * 2 // 5`` tokens with the least hash in it (the first of equals).  Equal windows have equal anchors, so
windows are compared only with those that share the anchor's gram, their *prefix*.  Consecutive windows of a
document with one anchor are a *stretch*, one row: about two in ``size * 3 / 5`` tokens begin one.

1. Stretches whose prefix occurs once are unique and go.
2. Stretches equal as a whole (prefix and hash of all their tokens) are one class.  Members of a class of two or more
   are repeated.  Classes are counted before the shuffle, so copies by the thousand cost a row per task.
3. Where a prefix has several classes, one stretch of each is read from its text.  Prefixes with at most ``CLASSES``
   of them are small groups, which tasks solve in memory (by ``solve``, which the two operators bring).
4. Larger groups are split by longer prefixes.  Windows are dealt into cells by their distance from the anchor; all
   windows of a cell hold a common core, and only windows with equal cores can be equal.  Cells equal as a whole are
   settled by their count; of the rest, with cores that several classes share, windows are counted one by one, the
   prefix then being the whole window.  A core that one class has goes.

Token sequences are compared by 64-bit hashes of tokens and of sequences, prefix and content together.  Rows are told
apart by id and 96 bits of hashes of the text (``_h`` and ``_x``), so an id may repeat, or be null in a third of all
rows; rows equal in id and text are copies of each other like any two documents.  Groups, stretches and lists are bounded by one document or by ``CLASSES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from sparsetab.lineage import cut
from sparsetab.llm.tokens import BYTE_CODES, RangeHash, slices, span_hashes, words_of

CLASSES = 256
_BYTES = 1 << 21
_CHUNK = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_TOKENS = 1 << 20  # tokens of small groups that a task solves at a time


def tokens(parts: list[bytes | None], unit: str):
    """Codes of the tokens of texts, token bounds by text, the joined bytes and byte bounds of tokens."""
    if unit == "words":
        data, starts, ends, bounds = words_of(parts)
        return span_hashes(data, starts, ends), bounds, data, starts, ends
    data = b"".join(p or b"" for p in parts)
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p or b"") for p in parts], out=bounds[1:])
    return np.frombuffer(data, dtype=np.uint8), bounds, data, None, None


def as_codes(codes: np.ndarray) -> np.ndarray:
    return BYTE_CODES[codes] if codes.dtype == np.uint8 else codes


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def gram_size(size: int) -> int:
    return max(1, size * 2 // 5)


def stretches(codes: np.ndarray, bounds: np.ndarray, size: int):
    """All windows of all texts as stretches: first window, number of windows, anchor, hash of prefix and of content."""
    k = gram_size(size)
    out = []
    for base in range(0, len(codes), _CHUNK):
        sub = as_codes(codes[base:base + _CHUNK + size - 1])
        n = len(sub) - size + 1
        if n <= 0:
            break
        hashes = RangeHash(sub)
        grams = hashes.grams(k)
        anchor = sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), size - k + 1) & _PLACE
        crossing = np.zeros(n + 1, dtype=np.int32)  # windows that a text's end lies in
        ends = bounds[1:][(bounds[1:] > base) & (bounds[1:] < base + n + size)] - base
        np.add.at(crossing, np.clip(ends - size + 1, 0, n), 1)
        np.add.at(crossing, np.clip(ends, 0, n), -1)
        whole = np.cumsum(crossing[:-1]) == 0
        begin = whole.copy()
        begin[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
        first = np.flatnonzero(begin)
        stop = np.append(np.flatnonzero(begin | ~whole), n)
        count = stop[np.searchsorted(stop, first, side="right")] - first
        at = anchor[first].astype(np.int64)
        out.append((first + base, count, at + base, grams[at], hashes.of(first, first + count + size - 1)))
    if not out:
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)] * 2
    return [np.concatenate(c) for c in zip(*out)]


ROW = ["_id", "_h", "_x"]  # what tells a row apart


def _rows(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("_id"), F.hash("text").alias("_h"), F.xxhash64("text").alias("_x"), F.col("text").cast("binary").alias("text"))


def identified(docs: DataFrame, id_column: str) -> DataFrame:
    """Id, hashes of the text, and the text compressed, as it is shuffled."""
    rows = _rows(docs, id_column)

    def shrink(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [None if t is None else squeeze.compress(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), pa.array(texts, pa.binary())], [*ROW, "text"])

    return rows.mapInArrow(shrink, rows.schema)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts as they were, a few megabytes at a time."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = [None if t is None else expand.decompress(t) for t in part.column("text").to_pylist()]
            yield part.set_column(at, "text", pa.array(texts, pa.binary()))


def _schema(docs: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    out = T.StructType([docs.schema["_id"], T.StructField("_h", T.IntegerType()), T.StructField("_x", T.LongType())])
    for name, kind in fields:
        out.add(name, T.DataType.fromDDL(kind))
    return out


def _found(rows: DataFrame, size: int, unit: str) -> DataFrame:
    """Stretches of all documents; ``span`` holds first window, number of windows and distance of the anchor.

    ``more`` is the distance to the next equal stretch of a row and the number of those.
    """

    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            codes, bounds, _, _, _ = tokens(texts, unit)
            first, count, anchor, key, content = stretches(codes, bounds, size)
            doc = np.searchsorted(bounds, first, side="right") - 1
            begin, more = _periods(doc, first, key, content)
            span = ((first - bounds[doc]) << 32) | (count << 16) | (anchor - first)
            own = batch.select(ROW).take(pa.array(doc[begin]))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(key[begin].view(np.int64)), pa.array(content[begin].view(np.int64)), pa.array(span[begin]), pa.array(more)],
                [*ROW, "key", "content", "span", "more"])

    return rows.mapInArrow(run, _schema(rows, ("key", "bigint"), ("content", "bigint"), ("span", "bigint"), ("more", "bigint")))


def _periods(doc: np.ndarray, first: np.ndarray, key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal stretches that follow each other at one distance, as in a word said over and over, are one row.

    Returns the stretches that begin such a row, and for each the distance and the number of those that follow.
    """
    if not len(first):
        return first, first
    same = np.zeros(len(first), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (content[1:] == content[:-1])
    step = np.diff(first, prepend=first[0])
    head = ~same
    head[1:] |= same[:-1] & (step[1:] != step[:-1])
    begin = np.flatnonzero(head)
    times = np.diff(np.append(begin, len(first)))
    follows = step[np.minimum(begin + 1, len(first) - 1)]
    return begin, np.where(times > 1, (follows << 32) | (times - 1), 0)


def _contexts(picked: DataFrame, size: int, unit: str) -> DataFrame:
    """From texts and the stretches picked in them: the tokens of small groups' stretches, the cells of large ones'.

    ``picked(_id, _h, _x, text, spans array<struct<key, span, m, large>>)``.  A small one has ``context``; a cell has its
    core's and content's hash and the hashes of its windows.
    """
    cells = max(1, isqrt(size - gram_size(size) + 1))

    def run(batches):
        for batch in unpacked(batches):
            columns = [batch.column(c).to_pylist() for c in (*ROW, "text", "spans")]
            out = []
            for *doc, text, spans in zip(*columns):
                codes, _, data, starts, ends = tokens([text], unit)
                hashes = RangeHash(as_codes(codes)) if any(s["large"] for s in spans) else None
                for s in spans:
                    first, count, far = s["span"] >> 32, (s["span"] >> 16) & 0xFFFF, s["span"] & 0xFFFF
                    if not s["large"]:
                        out.append((*doc, s["key"], s["m"], first, count, _text(data, starts, ends, first, first + count + size - 1, unit), None, None, None, None))
                        continue
                    anchor = first + far
                    windows = np.arange(first, first + count)
                    cell = (anchor - windows) // cells
                    for c in np.unique(cell).tolist():
                        own = windows[cell == c]
                        core = hashes.of(np.array([anchor - c * cells]), np.array([anchor - (c + 1) * cells + 1 + size]))
                        whole = hashes.of(own[:1], own[-1:] + size)
                        out.append((*doc, s["key"], s["m"], int(own[0]), len(own), None, c, int(core.view(np.int64)[0]), int(whole.view(np.int64)[0]),
                                    hashes.of(own, own + size).view(np.int64).tolist()))
                if len(out) >= 4096:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    schema = _schema(picked, ("key", "bigint"), ("m", "bigint"), ("first", "bigint"), ("n", "int"), ("context", "binary"),
                     ("cell", "int"), ("core", "bigint"), ("content", "bigint"), ("windows", "array<bigint>"))
    arrow = to_arrow_schema(schema)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return picked.mapInArrow(run, schema)


def _text(data: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int, unit: str) -> bytes:
    if unit == "bytes":
        return data[first:last]
    return b" ".join([data[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist())])


def names(codes: np.ndarray, starts: np.ndarray, size: int, depth: int, name: np.ndarray | None = None) -> np.ndarray:
    """A number for each start, equal where the next ``size`` codes are equal; in order of a fixed order of suffixes.

    Names at twice the depth are those of pairs of names, as in the naming of Karp, Miller and Rosenberg; the first
    names are those of runs of ``depth`` codes, which may be given as ``name``.  A start too near the end of ``codes`` must not be asked for.
    """
    if name is None:
        name = np.unique(RangeHash(codes).grams(depth), return_inverse=True)[1].astype(np.uint64)
    while depth < size:
        step = min(depth, size - depth)
        if depth + step == size:
            pair = (name[starts] << np.uint64(32)) | name[starts + step]
        else:
            pair = (name[:-step] << np.uint64(32)) | name[step:]
        name = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        depth += step
        if depth == size:
            return name
    return name[starts]


Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bool], np.ndarray]


def _solved(small: DataFrame, size: int, unit: str, keep_first: bool, solve: Solver) -> DataFrame:
    """Repeated windows of small groups, which come with the rows of a group one after another."""

    def run(batches):
        own: list = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in (*ROW, "key", "m", "first", "n", "context"))):
                if own and r[:7] == own[-1][:7]:  # the same stretch, from a row that is given twice
                    continue
                if own and held >= _TOKENS and r[3] != own[-1][3]:
                    yield work(own)
                    own, held = [], 0
                own.append(r)
                held += len(r[7]) if unit == "bytes" else r[6] + size
        if own:
            yield work(own)

    def work(own):
        codes, bounds, _, _, _ = tokens([r[7] for r in own], unit)
        count = np.array([r[6] for r in own])
        row = np.repeat(np.arange(len(own)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = bounds[row] + within
        # rows in order of id, hashes of the text and place, for what comes first
        order = np.empty(len(own), dtype=np.int64)
        order[sorted(range(len(own)), key=lambda i: (own[i][0] is not None, *own[i][:3], own[i][5]))] = np.arange(len(own))
        hit = solve(as_codes(codes), starts, order[row], within, np.array([r[4] for r in own])[row], size, keep_first)
        begin = hit.copy()
        begin[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
        first = np.flatnonzero(begin)
        stop = np.append(np.flatnonzero(begin | ~hit), len(hit))
        n = stop[np.searchsorted(stop, first, side="right")] - first
        picked = row[first]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([own[i][k] for i in picked], kind) for k, kind in enumerate(kinds)),
             pa.array(np.array([r[5] for r in own], dtype=np.int64)[picked] + within[first]), pa.array(n.astype(np.int64))], [*ROW, "first", "n"])

    kinds = [to_arrow_type(small.schema[c].dataType) for c in ROW]
    return small.mapInArrow(run, _schema(small, ("first", "bigint"), ("n", "bigint")))


def _large(cells: DataFrame, keep_first: bool) -> DataFrame:
    """Repeated windows of groups too large for a task, by longer prefixes."""
    place = F.struct(*ROW, "first")
    kinds = cut(cells.groupBy("key", "cell", "core", "content").agg(F.sum("m").alias("m"), F.min(F.struct(*ROW, "first", "n", "windows")).alias("rep")))
    settled = cells.join(kinds.where("m > 1").select(*(F.col(c).alias("_" + c) for c in ("key", "cell", "core", "content")), "rep"),
                         (F.col("key") == F.col("_key")) & (F.col("cell") == F.col("_cell")) & (F.col("core") == F.col("_core")) & (F.col("content") == F.col("_content")))
    if keep_first:
        settled = settled.where(~place.eqNullSafe(F.struct(*[f"rep.{c}" for c in ROW], "rep.first")))
    shared = cut(kinds.groupBy("key", "cell", "core").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    open_ = kinds.join(shared.select(F.col("key").alias("_key"), F.col("cell").alias("_cell"), F.col("core").alias("_core")),
                       (F.col("key") == F.col("_key")) & (F.col("cell") == F.col("_cell")) & (F.col("core") == F.col("_core")))
    windows = cut(open_.select("key", "m", *[f"rep.{c}" for c in ROW], "rep.first", F.posexplode("rep.windows").alias("i", "window")).select(
        "key", "window", *ROW, (F.col("first") + F.col("i")).alias("first"), "m"))
    counts = cut(windows.groupBy("key", "window").agg(F.count("*").alias("c"), F.min(place).alias("least")).where("c > 1"))
    counted = windows.join(counts.select(F.col("key").alias("_key"), F.col("window").alias("_window"), "least"),
                           (F.col("key") == F.col("_key")) & (F.col("window") == F.col("_window")))
    if keep_first:
        counted = counted.where(~place.eqNullSafe(F.col("least")))
    return settled.select(*ROW, "first", F.col("n").cast("bigint").alias("n")).unionByName(
        counted.select(*ROW, "first", F.lit(1).cast("bigint").alias("n")))


def same_row():
    """Join of rows with a table whose keys begin with ``_of``; only ids can be null."""
    return F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_h") == F.col("_of_h")) & (F.col("_x") == F.col("_of_x"))


def repeated(docs: DataFrame, size: int, unit: str, keep_first: bool, solve: Solver, id_column: str = "doc_id",
             most_classes: int = CLASSES) -> DataFrame:
    """Runs of windows that occur elsewhere: ``(_id, _h, _x, runs array<struct<first, n, more>>)``, a row for each document with any.

    With ``keep_first``, windows that occur *earlier*, in order of id, hashes of the text and place, null ids first; rows
    equal in id and text then count as one document.
    """
    found = cut(_found(_rows(docs, id_column), size, unit))
    times = F.col("more").bitwiseAND(F.lit(0xFFFFFFFF)) + 1
    again = cut(found.groupBy("key").agg(F.sum(times).alias("c")).where("c > 1").select("key"))
    kept = cut(found.join(again, "key", "left_semi"))
    place = F.struct(*ROW, "span")
    classes = cut(kept.groupBy("key", "content").agg(F.sum(times).alias("m"), F.min(place).alias("rep")))
    groups = cut(classes.groupBy("key").agg(F.count("*").alias("c"), F.count_if(F.col("m") == 1).alias("singles")).where(
        "c > 1" if keep_first else "c > 1 AND singles > 0").select(F.col("key").alias("_key"), (F.col("c") > most_classes).alias("large")))
    pool = classes.join(groups, F.col("key") == F.col("_key")).select(
        *[F.col(f"rep.{c}").alias(f"_of{c}") for c in ROW], F.struct("key", "rep.span", "m", "large").alias("s"))
    by_doc = pool.groupBy(*[f"_of{c}" for c in ROW]).agg(F.collect_list("s").alias("spans"))
    texts = identified(docs, id_column).join(by_doc, same_row()).select(*ROW, "text", "spans")
    contexts = cut(_contexts(texts, size, unit))
    small = contexts.where("context IS NOT NULL").select(*ROW, "key", "m", "first", "n", "context")
    solved = _solved(small.repartition("key").sortWithinPartitions("key", *ROW, "first"), size, unit, keep_first, solve)
    large = _large(contexts.where("context IS NULL").drop("context"), keep_first)
    settled = kept.join(classes.where("m > 1").select(F.col("key").alias("_key"), F.col("content").alias("_content"), "rep"),
                        (F.col("key") == F.col("_key")) & (F.col("content") == F.col("_content")))
    runs = settled.select(*ROW, F.shiftright("span", 32).alias("first"), F.shiftright("span", 16).bitwiseAND(F.lit(0xFFFF)).cast("bigint").alias("n"),
                          "more", place.eqNullSafe(F.col("rep")).alias("is_first"))
    if keep_first:  # the first stretch of the class stays; those that follow it in its row go
        step = F.shiftright("more", 32)
        runs = runs.where(~F.col("is_first") | (F.col("more") > 0)).select(
            *ROW, F.when(F.col("is_first"), F.col("first") + step).otherwise(F.col("first")).alias("first"), "n",
            F.when(F.col("is_first"), F.col("more") - 1).otherwise(F.col("more")).alias("more"))
    alone = F.lit(0).cast("bigint").alias("more")
    runs = runs.select(*ROW, "first", "n", "more").unionByName(solved.select("*", alone)).unionByName(large.select("*", alone))
    return runs.groupBy(*ROW).agg(F.collect_list(F.struct("first", "n", "more")).alias("runs"))


def covered(runs, count: int, size: int) -> np.ndarray:
    """Which of ``count`` tokens lie in a window of the runs."""
    change = np.zeros(count + 1, dtype=np.int64)
    for r in runs or ():
        for first in range(r["first"], r["first"] + (r["more"] >> 32) * (r["more"] & 0xFFFFFFFF) + 1, max(1, r["more"] >> 32)):
            change[first] += 1
            change[first + r["n"] - 1 + size] -= 1
    return np.cumsum(change[:-1]) > 0


def removed(docs: DataFrame, size: int, unit: str, keep_first: bool, solve: Solver, work: Callable, fields: tuple[tuple[str, str], ...], id_column: str) -> DataFrame:
    """Every document with what ``work(texts, runs)`` makes of it: a list of columns, for texts as bytes (or None) and their runs.

    Beside the id stand ``text_hash`` and ``text_key``, Spark's ``hash`` and ``xxhash64`` of the text, which tell rows with one id apart.
    """
    runs = repeated(docs, size, unit, keep_first, solve, id_column).select(*[F.col(c).alias(f"_of{c}") for c in ROW], "runs")
    rows = identified(docs, id_column).join(runs, same_row(), "left").select(*ROW, "text", "runs")
    schema = T.StructType([T.StructField(id_column, rows.schema["_id"].dataType), T.StructField("text_hash", T.IntegerType()), T.StructField("text_key", T.LongType())])
    for name, kind in fields:
        schema.add(name, T.DataType.fromDDL(kind))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in unpacked(batches):
            columns = work(batch.column("text").to_pylist(), batch.column("runs").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[3:]))], schema=arrow)

    return rows.mapInArrow(run, schema)
