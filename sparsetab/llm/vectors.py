"""Near-dedup of embeddings by quantised tile products.

Vectors are compared only under equal labels.  Equal vectors of a label are one class, whose members are counted and
never paired.  The classes of a label are dealt into tiles of about ``TILE`` by hash, so a label with a third of all
rows just has more tiles, and every pair of tiles of a label is one row of work.

In a pair of tiles the unit vectors are compared as 8-bit integers first.  With ``u = s q + e`` for the quantised
vector ``s q``, the cosine of two vectors differs from ``s q . s' q'`` by at most ``|e| + |s q| |e'|``; the norms of
the errors are known for each vector.  Only pairs that this bound leaves possible are computed in double precision.
A pair of tiles returns sums (links of a class) and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.lineage import cut
from sparsetab.llm.linking import components

TILE = 1024
_CLASS = "label long, class binary, x binary, vec_id long"
_SLACK = 1e-5  # above the rounding of the float32 sums that bounds are compared in


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and bytes of each vector that can link; the caller has dropped those that cannot."""
    for batch in batches:
        rows = [np.array(x, dtype=np.float64) + 0.0 for x in batch.column("x").to_pylist()]
        raw = [r.tobytes() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()),
             batch.column("vec_id")], ["label", "class", "x", "vec_id"])


def linkable(x: str, label: str):
    """Whether a vector can have links: no null in it or in its label, finite, not zero."""
    return F.col(label).isNotNull() & F.col(x).isNotNull() & F.forall(
        F.col(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(F.col(x), lambda v: v != 0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tile; the rows of a tile come one after another."""
    open_key, own = None, []

    def row():
        width = max(len(r[1]) for r in own)
        x = np.zeros((len(own), width // 8))
        for i, r in enumerate(own):
            x[i, :len(r[1]) // 8] = np.frombuffer(r[1])
        return pa.RecordBatch.from_arrays(
            [pa.array([open_key[0]], pa.int64()), pa.array([open_key[1]], pa.int64()), pa.array([open_key[2]], pa.int64()), pa.array([len(own)], pa.int32()),
             pa.array([b"".join(r[0] for r in own)], pa.binary()), pa.array([np.array([r[2] for r in own], dtype=np.int64).tobytes()], pa.binary()),
             pa.array([x.tobytes()], pa.binary())], ["label", "tiles", "tile", "n", "classes", "counts", "x"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("label", "tiles", "tile", "class", "x", "m")]
        for label, tiles, tile, *rest in zip(*columns):
            if (label, tiles, tile) != open_key and own:
                yield row()
                own = []
            open_key = (label, tiles, tile)
            own.append(rest)
    if own:
        yield row()


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers of unit vectors, step, length of the quantised vector and length of the error, by row."""
    unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    step = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / step[:, None]).astype(np.int8)
    near = q * step[:, None]
    return q, step, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision."""
    big = np.abs(x).max(axis=1), np.abs(y).max(axis=1)
    x, y = x / big[0][:, None], y / big[1][:, None]
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def linked(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with a cosine of ``least`` or more; ``y`` None: pairs i < j of ``x``."""
    q, s, size, error = quantised(x)
    p, t, other, wrong = (q, s, size, error) if y is None else quantised(y)
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of integers without rounding
    about = (q.astype(exact) @ p.astype(exact).T) * s[:, None].astype(exact) * t[None, :].astype(exact)
    bound = (error[:, None] + size[:, None] * wrong[None, :] + _SLACK).astype(exact)
    maybe = about + bound >= least
    if y is None:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    keep = np.concatenate([np.zeros(0, dtype=bool), *(
        _cosines(x[i[k:k + 65536]], (x if y is None else y)[j[k:k + 65536]]) >= least for k in range(0, len(i), 65536))])
    return i[keep], j[keep]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least number in the component of each of ``n`` nodes, by pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float = 0.93, tile: int = TILE) -> DataFrame:
    """``vectors(vec_id, x, label)`` with links of cosine ``least`` or more between vectors of one label.

    Returns ``vec_id, n_links, component_id, kept``, a row for each row.  Vectors that are null, zero or empty, hold
    null or non-finite components, or have no label link with nothing and are their own component.  Shorter vectors
    count as filled up with zeros.  Rows that repeat an id are vectors of their own.  A null id takes part in links;
    a component of null ids alone has a null id and keeps nothing.
    """
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("x").cast("array<double>").alias("x"))
    good = cut(rows.where(linkable("x", "label")).mapInArrow(_classes, _CLASS))
    members = good.groupBy("label", "class").agg(F.count("*").alias("m"), F.first("x").alias("x"))
    tiles = members.groupBy("label").agg(F.ceil(F.count("*") / tile).alias("tiles")).withColumnRenamed("label", "_label")
    dealt = members.join(tiles, F.col("label") == F.col("_label")).drop("_label").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")))
    packed = cut(dealt.repartition("label", "tile").sortWithinPartitions("label", "tile", "class").mapInArrow(
        _pack, "label long, tiles long, tile long, n int, classes binary, counts binary, x binary"))
    # tile i meets the tiles up to half of all tiles further on, in a circle: every tile has as many partners
    steps = F.sequence(F.lit(0).cast("long"), F.floor(F.col("tiles") / 2))
    body = F.struct("n", "classes", "counts", "x")
    further = F.transform(steps, lambda d: F.struct(F.col("tile").alias("i"), F.pmod(F.col("tile") + d, F.col("tiles")).alias("j"), d.alias("d")))
    once = F.filter(further, lambda k: (2 * k["d"] != F.col("tiles")) | (k["d"] == 0) | (k["i"] < k["j"]))
    back = F.transform(steps, lambda d: F.struct(F.pmod(F.col("tile") - d, F.col("tiles")).alias("i"), F.col("tile").alias("j")))
    left = packed.select("label", F.explode(once).alias("_k"), body.alias("a")).select("label", F.col("_k.i").alias("i"), F.col("_k.j").alias("j"), "a")
    right = packed.select("label", F.explode(F.array_distinct(back)).alias("_k"), body.alias("b")).select("label", F.col("_k.i").alias("i"), F.col("_k.j").alias("j"), "b")
    pairs = left.join(right, ["label", "i", "j"]).select("label", (F.col("i") == F.col("j")).alias("same"), "a", "b")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = ((np.frombuffer(r[s]["x"]).reshape(r[s]["n"], -1), np.frombuffer(r[s]["counts"], dtype=np.int64), r[s]["classes"]) for s in "ab")
                width = max(a[0].shape[1], b[0].shape[1])
                x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a[0], b[0]))
                i, j = linked(x, None if r["same"] else y, least)
                shift = 0 if r["same"] else len(x)
                counts = np.concatenate([a[1], b[1]]) if shift else a[1]
                links = np.bincount(i, weights=counts[j + shift], minlength=len(counts)) + np.bincount(j + shift, weights=counts[i], minlength=len(counts))
                root = spanning(i, j + shift, len(counts))
                some = np.flatnonzero(links > 0)
                names = a[2] + (b[2] if shift else b"")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["label"]] * len(some), pa.int64()), pa.array([names[16 * k:16 * k + 16] for k in some], pa.binary()),
                     pa.array(links[some].astype(np.int64)), pa.array([names[16 * root[k]:16 * root[k] + 16] for k in some], pa.binary())],
                    ["label", "class", "links", "root"])

    found = cut(pairs.mapInArrow(run, "label long, class binary, links long, root binary"))
    node = lambda c: F.concat(F.lpad(F.hex(F.col("label")), 16, "0"), F.hex(c))
    roots = components(found.select(node("class").alias("a"), node("root").alias("b")))
    links = found.groupBy("label", "class").agg(F.sum("links").alias("links")).withColumn("_node", node("class"))
    groups = members.drop("x").withColumn("_node", node("class")).join(links.select("_node", "links"), "_node", "left").join(
        roots, F.col("_node") == F.col("node"), "left").select(
        "_node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "_node").alias("_root"))
    ids = good.select("vec_id", node("class").alias("_node")).groupBy("_node").agg(F.min("vec_id").alias("_least"))
    named = cut(groups.join(ids, "_node").select("_node", "n_links", "_root", "_least"))
    component = cut(named.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("component_id")))
    of_node = named.join(component, F.col("_root") == F.col("_r")).select("_node", "n_links", "component_id")
    linked_rows = good.select("vec_id", node("class").alias("_node")).join(of_node, "_node").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(linkable("x", "label"), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
