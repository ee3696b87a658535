"""Encoding to and decoding from the merge-type pieces of a SentencePiece model, with seeded merge-dropout.

The vocabulary is read from a model file on the driver and sent to the tasks as arrays (its size is that of the
vocabulary).  A text is ``▁`` + the text with spaces as ``▁``.  Pieces hold ``▁`` only at their start (``load``
makes sure), so no merge crosses from a character to a following ``▁`` and each unit, a run of spaces with the
characters after it, is encoded by itself.

Encoding takes the candidate merges of a unit from an agenda, best rank first, leftmost among equals.  A candidate
is the pair of symbols that meet at given places.  With dropout it is skipped for good if its keyed hash (seed,
document, copy of it, place of the unit in the text, places of the pair) lies below the rate, so a rerun gives the
same pieces, another seed others, and every occurrence of a word is drawn anew.  The distinct units of a batch work off
their agendas without dropout.  Skipping a candidate that is not taken there changes nothing, so occurrences that skip
none of the merges taken have that result; the others work off an agenda of their own.  Agendas of units of one length
run side by side in NumPy; a unit of more than ``LONG`` characters has linked symbols and a heap to itself, so its cost
is in proportion to its length but for a logarithm.

Characters without a piece become byte pieces, ``▁`` in the text itself among them, so decoding is lossless for
every text whatever the rate.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparsetab.llm.tokens import mix, slices, span_hashes

MARK = "▁"
_BYTES = 1 << 21
_ROWS = 8192
LONG = 512  # characters of a unit from which it has a heap of its own
COPIES = 64  # copies of a row encoded in one go
_NO_RANK = np.int32(np.iinfo(np.int32).max)
_GONE = np.int32(-2)  # a symbol that has become part of the one before it
_NORMAL, _USER, _UNUSED, _BYTE = "normal", "user", "unused", "byte"


@dataclass
class Vocabulary:
    """Pieces by id as bytes (``▁`` as a space), byte pieces, characters and merges.

    Symbols 0..n-1 are pieces; further symbols are characters that occur in pieces without being one.  ``merges`` maps
    a pair of symbols to rank and merged symbol by open addressing.
    """

    texts: list[bytes]
    byte_ids: np.ndarray
    chars: dict[int, int]
    keys: np.ndarray
    merged: np.ndarray
    ranks: np.ndarray
    extra: list[int]
    known: dict[int, tuple[int, int]] | None = None

    def merges(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol by pair, for agendas with a heap; made when first asked for."""
        if self.known is None:
            used = self.keys != _EMPTY
            self.known = dict(zip(self.keys[used].tolist(), zip(self.ranks[used].tolist(), self.merged[used].tolist())))
        return self.known

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of the merge of each pair, -1 if there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        mask = np.uint64(len(self.keys) - 1)
        slot = mix(key) & mask
        found = np.full(len(key), -1, dtype=np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            found[open_[hit]] = slot[open_[hit]].astype(np.int64)
            open_ = open_[~hit & (there != _EMPTY)]
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
        return found


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def load(path: str) -> Vocabulary:
    """Vocabulary of a merge-type model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(len(model))]
    kinds = [_BYTE if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else _UNUSED if model.is_unused(i) else _NORMAL
             for i in range(len(model))]
    normal = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind in (_NORMAL, _UNUSED)}
    if any(MARK in name.lstrip(MARK) for name in normal):
        raise ValueError("a piece holds the space mark after another character; units cannot be cut at spaces")
    byte_ids = np.full(256, -1, dtype=np.int32)
    for i, kind in enumerate(kinds):
        if kind == _BYTE:
            byte_ids[int(names[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    symbols, extra = dict(normal), []
    for name in normal:
        for char in name:
            if char not in symbols:
                symbols[char] = len(names) + len(extra)
                extra.append(ord(char))
    order = {i: rank for rank, i in enumerate(sorted(normal.values(), key=lambda i: (-model.get_score(i), i)))}
    pairs = [(symbols[name[:cut]], symbols[name[cut:]], i) for name, i in normal.items() for cut in range(1, len(name))
             if name[:cut] in symbols and name[cut:] in symbols]
    size = 1 << (4 * len(pairs)).bit_length()
    keys, merged, ranks = np.full(size, _EMPTY), np.full(size, -1, dtype=np.int32), np.full(size, _NO_RANK)
    wanted = np.array([(a << 32) | b for a, b, _ in pairs], dtype=np.uint64)
    for key, slot, (_, _, i) in zip(wanted.tolist(), (mix(wanted) & np.uint64(size - 1)).tolist(), pairs):
        while keys[slot] != _EMPTY:
            slot = (slot + 1) % size
        keys[slot], merged[slot], ranks[slot] = key, i, order[i]
    texts = [bytes([int(name[3:5], 16)]) if kind == _BYTE else b"" if kind == "control" else name.replace(MARK, " ").encode()
             for name, kind in zip(names, kinds)]
    chars = {ord(char): i for char, i in symbols.items() if len(char) == 1 and char != MARK}
    return Vocabulary(texts, byte_ids, chars | {0x20: symbols[MARK]}, keys, merged, ranks, extra)


def _units(parts: list[bytes | None]):
    """Texts with a space before each (none for an empty one), bounds of their units, and unit bounds by text."""
    own = [b" " + p if p else b"" for p in parts]
    data = b"".join(own)
    raw = np.frombuffer(data, dtype=np.uint8)
    offsets = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in own], out=offsets[1:])
    space = raw == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(raw))
    return data, starts, ends, np.searchsorted(starts, offsets)


def _symbols(vocabulary: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Symbol of each character, -1 for characters outside the vocabulary."""
    distinct, at = np.unique(codes, return_inverse=True)
    return np.array([vocabulary.chars.get(c, -1) for c in distinct.tolist()], dtype=np.int32)[at]


def _skipped(key: np.ndarray, pair: np.ndarray, rate: float) -> np.ndarray:
    """Whether dropout skips the candidate ``pair`` of a unit with ``key``."""
    return (mix(key ^ pair) >> np.uint64(11)) < np.uint64(min(rate, 1.0) * float(1 << 53))


_WORD = (1 << 64) - 1


def _mixed(h: int) -> int:
    """``tokens.mix`` of one number."""
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _WORD
    return h ^ (h >> 31)


def _work_off_long(vocabulary: Vocabulary, sym: np.ndarray, key: int, rate: float, met: list | None) -> tuple[np.ndarray, np.ndarray]:
    """The agenda of one long unit, with symbols linked to the next and a heap of candidates.

    Returns the symbols that are left and the characters they begin at, the end last; draws are those of ``_work_off``.
    """
    merges, symbol, width = vocabulary.merges(), sym.tolist(), len(sym)
    after, before = list(range(1, width + 1)), list(range(-1, width - 1))  # by the character a symbol begins at
    limit = int(min(rate, 1.0) * float(1 << 53))
    heap: list[tuple[int, int, int, int, int, int]] = []

    def look(a: int) -> None:
        m = after[a]
        if m >= width or symbol[a] < 0 or symbol[m] < 0:
            return
        found = merges.get(symbol[a] << 32 | symbol[m])
        if found is None:
            return
        pair = _mixed(a << 42 ^ m << 21 ^ after[m])
        if rate <= 0 or _mixed(key ^ pair) >> 11 >= limit:
            heapq.heappush(heap, (found[0], a, m, after[m], found[1], pair))

    for a in range(width - 1):
        look(a)
    while heap:
        _, a, m, b, into, pair = heapq.heappop(heap)
        if symbol[a] is None or after[a] != m or symbol[m] is None or after[m] != b:
            continue
        if met is not None:
            met.append(pair)
        symbol[a], symbol[m], after[a] = into, None, b
        if b < width:
            before[b] = a
        look(a)
        if before[a] >= 0:
            look(before[a])
    at = [i for i in range(width) if symbol[i] is not None]
    return np.array([symbol[i] for i in at], dtype=np.int32), np.array([*at, width], dtype=np.int64)


def _work_off(vocabulary: Vocabulary, sym: np.ndarray, key: np.ndarray | None = None, rate: float = 0.0,
              met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Agendas of units of one length, side by side; ``met`` collects row and pair of the merges taken.

    ``sym(units, characters)``.  Returns the symbols that are left and the character each begins at; the place after
    the last holds the number of characters, later ones -1.
    """
    n, width = sym.shape
    sym = sym.copy()
    after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()  # symbols are known by the character they begin at
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()

    def pairs(rows, a, m):
        return mix((a.astype(np.uint64) << np.uint64(42)) ^ (m.astype(np.uint64) << np.uint64(21)) ^ after[rows, m].astype(np.uint64))

    def look(rows, a, m):
        """Rank and merged symbol of the symbols at ``a`` and ``m``, its next."""
        slot = vocabulary.pairs(sym[rows, a], sym[rows, m])
        rank, merged = np.where(slot >= 0, vocabulary.ranks[slot], _NO_RANK), vocabulary.merged[slot]
        if rate > 0:
            some = np.flatnonzero(slot >= 0)
            rank[some[_skipped(key[rows[some]], pairs(rows[some], a[some], m[some]), rate)]] = _NO_RANK
        return rank, merged

    rank = np.full((n, max(1, width)), _NO_RANK)
    into = np.zeros((n, max(1, width)), dtype=np.int32)
    if width > 1:
        rows, places = np.repeat(np.arange(n), width - 1), np.tile(np.arange(width - 1), n)
        rank[rows, places], into[rows, places] = look(rows, places, places + 1)
    active = np.arange(n)
    while len(active) and width > 1:
        a = rank[active].argmin(axis=1)
        some = rank[active, a] < _NO_RANK
        active, a = active[some], a[some]
        m = after[active, a]
        if met is not None:
            met.append((active, pairs(active, a, m)))
        b = after[active, m]
        sym[active, a], sym[active, m] = into[active, a], _GONE
        rank[active, a] = rank[active, m] = _NO_RANK
        after[active, a] = b
        ok = np.flatnonzero(b < width)
        before[active[ok], b[ok]] = a[ok]
        rank[active[ok], a[ok]], into[active[ok], a[ok]] = look(active[ok], a[ok], b[ok])
        p = before[active, a]
        ok = np.flatnonzero(p >= 0)
        rank[active[ok], p[ok]], into[active[ok], p[ok]] = look(active[ok], p[ok], a[ok])
    rows, places = np.nonzero(sym != _GONE)
    left = np.bincount(rows, minlength=n)
    to = np.arange(len(rows)) - np.repeat(np.cumsum(left) - left, left)
    out, at = np.full((n, width), -1, dtype=np.int32), np.full((n, width + 1), -1, dtype=np.int32)
    out[rows, to], at[rows, to] = sym[rows, places], places
    at[np.arange(n), left] = width
    return out, at


def encode_texts(parts: list[bytes | None], vocabulary: Vocabulary, rate: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and their bounds by text; ``key`` holds a 64-bit key for each text.

    With dropout every unit of a text draws by the text's key and its place in the text.
    """
    data, starts, ends, bounds = _units(parts)
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(len(parts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    _, one, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = ends[one] - starts[one]
    b = np.cumsum(lengths)
    a = b - lengths
    raw = raw[np.repeat(starts[one] - a, lengths) + np.arange(b[-1])]  # from here on the distinct units in a row
    ahead = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=ahead[1:])  # characters before each byte
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    all_symbols = _symbols(vocabulary, codes)
    char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first, lengths = ahead[a], ahead[b] - ahead[a]

    def agendas(unit: np.ndarray, keys: np.ndarray | None, rate: float, met: list | None = None):
        """Ids of units (by number of the distinct unit) in a row, number of ids of each and where they begin."""
        flats, size, begin, done = [], np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit), dtype=np.int64), 0
        order = np.argsort(lengths[unit], kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[unit[order]])) + 1):
            width = int(lengths[unit[same[0]]])
            if width > LONG:
                for own in same:
                    left, found = first[unit[own]], None if met is None else []
                    sym, places = _work_off_long(vocabulary, all_symbols[left:left + width], 0 if keys is None else int(keys[own]), rate, found)
                    if found:
                        met.append((np.full(len(found), own), np.array(found, dtype=np.uint64)))
                    flat, n = _with_bytes(vocabulary, raw, char_at, sym, left + places[:-1], left + places[1:])
                    size[own], begin[own] = len(flat), done
                    flats.append(flat)
                    done += len(flat)
                continue
            rows = max(1, min(_ROWS, (1 << 18) // max(1, width)))
            for i in range(0, len(same), rows):
                own = same[i:i + rows]
                left, found = first[unit[own]][:, None], None if met is None else []
                sym, places = _work_off(vocabulary, all_symbols[left + np.arange(width)], None if keys is None else keys[own], rate, found)
                if found:
                    met.extend((own[r], pair) for r, pair in found)
                kept = places[:, 1:] >= 0
                flat, n = _with_bytes(vocabulary, raw, char_at, sym[kept], (left + places[:, :-1])[kept], (left + places[:, 1:])[kept])
                per_unit = np.bincount(np.nonzero(kept)[0], weights=n, minlength=len(own)).astype(np.int64)
                size[own], begin[own] = per_unit, done + np.cumsum(per_unit) - per_unit
                flats.append(flat)
                done += len(flat)
        return np.concatenate(flats), size, begin

    met: list | None = [] if rate > 0 else None
    flat, size, begin = agendas(np.arange(len(one)), None, 0.0, met)
    if met:
        place = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))
        keys = mix(np.repeat(mix(key), np.diff(bounds)) ^ mix(place.astype(np.uint64)))
        unit, pair = (np.concatenate(x) for x in zip(*met))
        order = np.argsort(unit, kind="stable")
        pair, n = pair[order], np.bincount(unit, minlength=len(one))
        before = np.cumsum(n) - n
        n, before = n[at], before[at]
        row = np.repeat(np.arange(len(at)), n)
        own = pair[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before, n)]
        apart = np.unique(row[_skipped(keys[row], own, rate)])
        if len(apart):
            more, sizes, begins = agendas(at[apart], keys[apart], rate)
            at[apart] = len(one) + np.arange(len(apart))
            flat, size, begin = np.concatenate([flat, more]), np.concatenate([size, sizes]), np.concatenate([begin, begins + len(flat)])
    n = size[at]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(begin[at] - total[:-1], n) + np.arange(total[-1])]
    return ids, total[bounds]


def _with_bytes(vocabulary: Vocabulary, raw: np.ndarray, char_at: np.ndarray, sym: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols, those without a piece spelled by the bytes of their characters; number of ids of each."""
    odd = np.flatnonzero((sym < 0) | (sym >= len(vocabulary.texts)))
    n = np.ones(len(sym), dtype=np.int64)
    if not len(odd):
        return sym, n
    a = char_at[first[odd]]
    n[odd] = char_at[last[odd]] - a
    out, to = np.repeat(sym, n), np.cumsum(n)[odd] - n[odd]
    within = np.arange(n[odd].sum()) - np.repeat(np.cumsum(n[odd]) - n[odd], n[odd])
    out[np.repeat(to, n[odd]) + within] = vocabulary.byte_ids[raw[np.repeat(a, n[odd]) + within]]
    return out, n


def decode_ids(ids: list[int] | np.ndarray, vocabulary: Vocabulary) -> bytes:
    """Text of ids: their pieces in a row, without the space put before the text."""
    texts = vocabulary.texts
    return b"".join([texts[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary, rate: float = 0.0, seed: int = 0,
           check: bool = False) -> DataFrame:
    """``docs(id columns..., text)`` with ``text`` replaced by ``ids``, an array of piece numbers.

    With ``check``, the ids are decoded again in the same pass: ``lossless`` says whether they gave the text.

    A null text gives null (and is lossless), an empty one an empty array.  Dropout is keyed by id, text and the number of
    the row among those equal in both, so copies are cut differently.  Rows are told apart by all their columns but maps;
    where some are equal in all of them they are counted first, and copies are dealt out ``COPIES`` at a time, so a row
    repeated a million times is no task's alone.  Where no row is repeated no text is moved.  Other columns pass through;
    a column ``ids`` is replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "ids", *["lossless"] * check)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    keyed = rows.withColumn("key", F.lit(0).cast("long"))
    if rate > 0:
        told = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name in others and "map<" not in f.dataType.simpleString()]
        same = [F.xxhash64(F.lit(seed), F.lit(n), F.col("text"), *told).alias(f"h{n}") for n in (1, 2)]
        copy = F.lit(1).cast("long")
        spread = rows
        if not rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            counted = rows.groupBy(*same).agg(F.first(F.struct("row", "text")).alias("one"), F.count("*").alias("n"))
            parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
            dealt = parts.repartition("h1", "part").withColumn("copy", F.explode(F.sequence(
                F.col("part") * COPIES + 1, F.least("n", (F.col("part") + 1) * COPIES))))
            spread, copy = dealt.select("one.*", "copy"), F.col("copy")
        keyed = spread.select("row", "text", F.xxhash64(F.lit(seed), F.lit(3), F.col("text"), *told, copy).alias("key"))

    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            ids, bounds = encode_texts(texts, vocabulary, rate, batch.column("key").to_numpy().view(np.uint64))
            there = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=there)
            same = [pa.array([decode_ids(ids[a:b], vocabulary) == (t or b"") for t, a, b in zip(texts, bounds[:-1], bounds[1:])], pa.bool_())] * check
            yield pa.RecordBatch.from_arrays([*batch.column("row").flatten(), lists, *same], [*others, "ids", *["lossless"] * check])

    schema = docs.select(*others).schema.add("ids", T.ArrayType(T.IntegerType()))
    if check:
        schema = schema.add("lossless", T.BooleanType())
    return keyed.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded(id columns..., ids)`` with ``ids`` replaced by ``text``; null ids give null, no ids the empty text."""
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            texts = [None if not x.is_valid else decode_ids(x.values.to_numpy(), vocabulary).decode("utf-8", "replace") for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    return encoded.mapInArrow(run, encoded.select(*others).schema.add("text", T.StringType()))
