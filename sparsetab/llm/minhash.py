"""Near-dedup of documents by MinHash, with links confirmed on full shingle sets.

A document is the set of its runs of ``k`` words (lower case in ASCII), as 64-bit hashes.  Documents with equal sets
are one class; only classes are compared, so copies are never paired.

*Signatures.*  One permutation: the hash range is cut into bins and the least hash of each bin is its value.  An empty
bin takes the value of another bin, the first filled one in its own fixed random order of bins (optimal
densification).  ``ROWS`` bins make a band, classes with an equal band share a bucket.  Two sets of similarity s miss
each other in all bands with chance ``(1 - s^ROWS)^BANDS``: 1 in 80 000 at 0.8.

*Candidates.*  A bucket gives a star: its members against its least member, one pair a member.  Pairs are confirmed
and linked documents joined to components.  Most buckets then lie in one component and are done, however large: no
pair left in them could join anything.  In the others, members outside the bucket's largest component are tried
against ``TRIES`` more members of it.

*The rest, exactly.*  Classes of buckets that still hold several components are compared by prefixes: of the shingles
of a set, rarest first, two similar sets share one among the first fifth (for a similarity of 0.8), at places that
leave enough shingles after them.  Rare is judged by a table of counts of fixed size; any order gives the same
links.  Classes that share a prefix shingle are paired if their components differ, again without the pairs within
the largest one.  So the components are those of all pairs that share a bucket, and more; a passage that very many
documents share is too frequent to stand in a prefix and makes no pairs.

*Confirmation.*  Sets are sent to the star's centre; a centre with many members is split into pieces.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.lineage import cut
from sparsetab.llm.linking import components
from sparsetab.llm.repeats import ROW, identified, same_row, unpacked
from sparsetab.llm.tokens import RangeHash, mix, slices, span_hashes, words_of

WORDS = 5
PERCENT = 80
BANDS, ROWS = 48, 7
BINS = BANDS * ROWS
TRIES = 4
SLOTS = 1 << 18  # of the table of counts
PIECE = 256  # members that one copy of a centre is compared with
_BYTES = 1 << 21
_FEW = 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``k`` words of each text; fewer words are one run, none is the empty set."""
    data, starts, ends, bounds = words_of(texts)
    h = span_hashes(data.translate(_LOWER), starts, ends)
    hashes = RangeHash(h)
    grams = hashes.grams(k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(mix(hashes.of(np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a fixed random order of all bins, and the place of each bin in that order."""
    if bins in _tables:
        return _tables[bins]
    order = np.argsort(np.random.default_rng(20).random((bins, bins)), axis=1).astype(np.int32)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(bins, dtype=np.int32)[None, :], axis=1)
    _tables[bins] = order, place
    return order, place


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Value of each bin for each set that is not empty (rows of empty sets are zero)."""
    order, place = _orders(bins)
    values = np.zeros((len(sets), bins), dtype=np.uint64)
    filled = np.zeros((len(sets), bins), dtype=bool)
    for i, own in enumerate(sets):
        at = ((own >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # rises with the hash
        first = np.flatnonzero(np.diff(at, prepend=-1))
        values[i, at[first]] = own[first]
        filled[i, at[first]] = True
    n = filled.sum(axis=1)
    for i in np.flatnonzero((n > 0) & (n <= _FEW)):
        there = np.flatnonzero(filled[i])
        values[i] = np.where(filled[i], values[i], values[i, there[place[:, there].argmin(axis=1)]])
    doc, bin_ = np.nonzero(~filled & (n > _FEW)[:, None])
    for t in range(bins):
        if not len(doc):
            break
        probe = order[bin_, t]
        hit = filled[doc, probe]
        values[doc[hit], bin_[hit]] = values[doc[hit], probe[hit]]
        doc, bin_ = doc[~hit], bin_[~hit]
    return values


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket of each band."""
    parts = values.reshape(len(values), -1, rows)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _signed(rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch, texts in slices(batches, "text", _BYTES):
            sets = shingles(texts, k)
            buckets = bands(signatures(sets))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * buckets.shape[1]), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_h"), batch.column("_x"), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), lists], ["_id", "_h", "_x", "set", "n", "bands"])

    schema = rows.select("_id", "_h", "_x").withColumn("set", F.lit(b"")).withColumn("n", F.lit(0).cast("long")).withColumn("bands", F.array(F.lit(0).cast("long"))).schema
    return rows.mapInArrow(run, schema)


def _sets(wanted: DataFrame, docs: DataFrame, id_column: str, k: int) -> DataFrame:
    """``(set, hashes)`` of the classes ``wanted(_of_id, _of_h, _of_x)``, read from the text of one document of each."""
    texts = identified(docs, id_column).join(wanted, same_row()).select("text")

    def run(batches):
        for batch in unpacked(batches):
            raw = [own.tobytes() for own in shingles(batch.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([pa.array([blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["set", "hashes"])

    return texts.mapInArrow(run, "set binary, hashes binary")


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes of ``sets(set, n, root, hashes)``: a row for each of their shingles, with its place in the order."""

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("hashes").to_pylist():
                total += np.bincount((mix(np.frombuffer(raw, dtype=np.uint64)) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "c"])

    # one row a slot at most, whatever the input
    rows = sets.select("hashes").mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[rows["slot"].to_numpy(dtype=np.int64)] = rows["c"].to_numpy(dtype=np.int64)

    def run(batches):
        for batch in batches:
            out = []
            for n, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "hashes"))):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                slot = (mix(hashes) % np.uint64(SLOTS)).astype(np.int64)
                first = np.lexsort((hashes, counts[slot]))[:n - -(-percent * n // 100) + 1]
                out.append((len(first), hashes[first].view(np.int64)))
            if out:
                row = pa.array(np.repeat(np.arange(len(out)), [n for n, _ in out]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in ("set", "n", "root")), pa.array(np.concatenate([t for _, t in out])),
                     pa.array(np.concatenate([np.arange(n) for n, _ in out]))], ["set", "n", "root", "bucket", "place"])

    return sets.mapInArrow(run, "set binary, n long, root binary, bucket long, place long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` of classes, those that are similar enough."""
    pieces = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PIECE).alias("pieces")))
    placed = pairs.join(pieces.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select(
        F.col("b").alias("set"), F.struct(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("pieces")).alias("piece"), F.lit(False).alias("is_centre")).alias("to"))
    centres = pieces.select(F.col("a").alias("set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")).select(
        "set", F.struct(F.col("set").alias("centre"), "piece", F.lit(True).alias("is_centre")).alias("to"))
    wanted = placed.unionByName(centres).groupBy("set").agg(F.collect_list("to").alias("to"))
    sent = sets.join(wanted.withColumnRenamed("set", "_set"), F.col("set") == F.col("_set")).select("set", "hashes", F.explode("to").alias("to")).select(
        "to.centre", "to.piece", "to.is_centre", "set", "hashes")

    def compare(batches):
        name, centre = None, None
        for batch in batches:
            found = []
            for c, is_centre, own, raw in zip(*(batch.column(x).to_pylist() for x in ("centre", "is_centre", "set", "hashes"))):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                if is_centre:
                    name, centre = c, hashes
                    continue
                assert name == c, "the centre comes first"
                at = np.searchsorted(centre, hashes)
                same = int((centre[np.minimum(at, len(centre) - 1)] == hashes).sum())
                if 100 * same >= percent * (len(centre) + len(hashes) - same):
                    found.append((c, own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return sent.repartition("centre", "piece").sortWithinPartitions("centre", "piece", F.col("is_centre").desc()).mapInArrow(compare, "a binary, b binary")


def _open(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Members of the buckets that hold several components, with their component and the bucket's largest (``bulk``)."""
    if roots is not None:
        members = members.join(roots, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set")).drop("node")
    placed = cut(members)
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    open_ = cut(sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select(
        F.col("bucket").alias("_bucket"), F.col("most.root").alias("bulk")))
    return cut(placed.join(open_, F.col("bucket") == F.col("_bucket")).drop("_bucket"))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id") -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= percent * union`` of their sets.

    ``docs`` has ``id_column`` and ``text``; other columns are not read.  Returns the id, ``n_shingles``, ``component_id``
    (least id of the group), ``kept`` (whether the id is that one) and ``text_hash``, which tells rows with one id apart.

    Null and empty texts, and texts of white space, have the empty set and are a group each.  Rows that repeat an id are
    documents of their own.  Null ids take part; a group of null ids alone has a null id and keeps nothing.  An empty
    table gives no rows.
    """
    out = _grouped(docs, k, percent, id_column)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col("_id") == own, F.lit(False)).alias("kept"), F.col("_h").alias("text_hash"))


def _grouped(docs: DataFrame, k: int, percent: int, id_column: str) -> DataFrame:
    """``(_id, _h, _x, n, root, component_id)`` of every row, with two hashes of its text; no root where the set is empty."""
    rows = docs.select(F.col(id_column).alias("_id"), F.hash("text").alias("_h"), F.xxhash64("text").alias("_x"), F.col("text").cast("binary").alias("text"))
    signed = cut(_signed(rows, k))
    classes = cut(signed.where("n > 0").groupBy("set", "n").agg(F.min(F.struct(*ROW)).alias("rep"), F.min("_id").alias("least"), F.first("bands").alias("bands")))
    buckets = classes.select("set", "n", F.explode("bands").alias("bucket"))
    full = cut(buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"))
    members = cut(buckets.join(full, "bucket", "left_semi"))
    fits = lambda n, other: 100 * F.least(n, other) >= percent * F.greatest(n, other)

    reps = members.select("set").distinct().join(classes.select(F.col("set").alias("_set"), "rep"), F.col("set") == F.col("_set")).select(
        *[F.col(f"rep.{c}").alias(f"_of{c}") for c in ROW])
    sets = cut(_sets(reps, docs, id_column, k))  # a row given twice gives its set twice, which does no harm

    stars = cut(members.groupBy("bucket").agg(F.min(F.struct("set", "n")).alias("centre")).withColumnRenamed("bucket", "_bucket"))
    pairs = cut(members.join(stars, F.col("bucket") == F.col("_bucket")).where((F.col("set") != F.col("centre.set")) & fits(F.col("n"), F.col("centre.n"))).select(
        F.col("centre.set").alias("a"), F.col("set").alias("b")).distinct())
    links = cut(_confirmed(pairs, sets, percent))
    roots = components(links)

    inside = _open(members, roots)
    tries = [F.min_by(F.struct("set", "n"), F.when(F.col("root") == F.col("bulk"), F.xxhash64("set", F.lit(i)))).alias(f"t{i}") for i in range(TRIES)]
    others = cut(inside.groupBy(F.col("bucket").alias("_bucket")).agg(*tries).select("_bucket", F.explode(F.array(*[f"t{i}" for i in range(TRIES)])).alias("t")).distinct())
    more = cut(inside.where("root <> bulk").join(others, F.col("bucket") == F.col("_bucket")).where(fits(F.col("n"), F.col("t.n"))).select(
        F.col("t.set").alias("a"), F.col("set").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = cut(links.unionByName(_confirmed(more, sets, percent)))
        roots = components(links)
        inside = _open(members, roots)

    left = inside.select("set", "n", "root").distinct()
    if not left.isEmpty():
        held = sets.join(left.withColumnRenamed("set", "_set"), F.col("set") == F.col("_set")).select("set", "n", "root", "hashes")
        shared = _open(cut(_rare_first(cut(held), percent)))
        outside = shared.where("root <> bulk").select(
            F.col("bucket").alias("_bucket"), F.col("set").alias("a"), F.col("n").alias("m"), F.col("root").alias("_root"), F.col("place").alias("_place"))
        enough = (100 + percent) * F.least(F.col("m") - F.col("_place"), F.col("n") - F.col("place")) >= percent * (F.col("m") + F.col("n"))
        last = cut(outside.join(shared, (F.col("_bucket") == F.col("bucket")) & (F.col("_root") != F.col("root")) & fits(F.col("m"), F.col("n")) & enough).where(
            (F.col("root") == F.col("bulk")) | (F.col("a") < F.col("set"))).select("a", F.col("set").alias("b")).distinct())
        links = cut(links.unionByName(_confirmed(last, sets, percent)))
        roots = components(links)

    named = cut(classes.select("set", "least").join(roots, F.col("set") == F.col("node"), "left").select("set", "least", F.coalesce("root", "set").alias("root")))
    groups = cut(named.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id")))
    component = named.join(groups, F.col("root") == F.col("_root")).select(F.col("set").alias("_set"), "root", "component_id")
    return signed.select("_id", "_h", "_x", "set", "n").join(component, (F.col("set") == F.col("_set")) & (F.col("n") > 0), "left")


def deduplicated(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id") -> DataFrame:
    """One document of each group, with all its columns: the one with the least id, of equal ids the least text hash.

    Null ids come last.  A group is a component, not an id: rows with one id and unrelated texts are in groups of their own.
    Texts with the empty set are a group for each id and text.
    """
    grouped = _grouped(docs, k, percent, id_column).select("n", "root", F.struct(F.col("_id").isNull().alias("null"), "_id", "_x").alias("_key"))
    found = grouped.where("n > 0").groupBy("root").agg(F.min("_key").alias("_kept")).select("_kept").unionByName(
        grouped.where("n = 0").select(F.col("_key").alias("_kept")).distinct())
    rows = docs.withColumn("_key", F.struct(F.col(id_column).isNull().alias("null"), F.col(id_column).alias("_id"), F.xxhash64("text").alias("_x")))
    # a struct equals another with the same nulls, so null ids meet
    return rows.join(found, F.col("_key") == F.col("_kept")).dropDuplicates(["_key"]).drop("_key", "_kept")
