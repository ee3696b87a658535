"""Embedding near-dedup and exact top-k search against all pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparsetab.llm import nearest, vectors


def test_bounds_hold():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 24)) * np.exp(draw.normal(size=(60, 1)) * 20)
    q, step, size, error = vectors.quantised(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    about = (q * step[:, None]) @ (q * step[:, None]).T
    assert (np.abs(unit @ unit.T - about) <= error[:, None] + size[:, None] * error[None, :] + 1e-12).all()


def cloud(seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(12, 16))
    x = np.concatenate([base[i % 12][None, :] + draw.normal(size=(1, 16)) * 0.25 for i in range(150)] + [base])
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 3) if i % 11 else 1) for i, r in enumerate(x)]
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(20)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, rows[1][1], None), (305, [], 1),
             (306, [float("inf")] + [1.0] * 15, 1), (307, [2 * v for v in rows[2][1]], rows[2][2]), (308, rows[3][1][:15], rows[3][2]), (5, rows[4][1], rows[4][2]), (None, rows[6][1], rows[6][2])]
    return rows


def brute(rows, least):
    def vector(r):
        x = r[1]
        if x is None or r[2] is None or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            return None
        return np.array(x + [0.0] * (16 - len(x)))

    xs = [vector(r) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        return a if root[a] == a else find(root[a])

    for i in range(len(rows)):
        for j in range(i):
            if xs[i] is not None and xs[j] is not None and rows[i][2] == rows[j][2]:
                if xs[i] @ xs[j] / np.sqrt((xs[i] @ xs[i]) * (xs[j] @ xs[j])) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return sorted(((r[0], links[i], low.get(find(i)) if xs[i] is not None else r[0]) for i, r in enumerate(rows)), key=repr)


def test_near_duplicates(spark):
    for seed, tile in ((1, 1024), (2, 9)):
        rows = cloud(seed)
        table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, x array<double>, label int, class int")
        got = vectors.near_duplicates(table, 0.93, tile).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute(rows, 0.93)
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = np.floor(draw.normal(size=(400, 8)) * np.exp(draw.normal(size=(400, 1))) * 20).astype(int)
    x[50:70] = x[50]  # ties
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(500, None), (None, [1] * 8), (510, []), (520, [3, 4])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "id long, x array<long>, score int")

    def want(k):
        good = [(i, np.array(v + [0] * (8 - len(v)))) for i, v in rows if i is not None and v is not None]
        for q, v in good:
            if q % 10 == 0:
                best = sorted(((int(-(v @ w)), i) for i, w in good if i != q))[:k]
                yield from ((q, n, i, -s) for n, (s, i) in enumerate(best, 1))

    for k, block, queries, seed in ((20, 4096, 512, 2048), (5, 16, 8, 32), (500, 64, 8, 32)):
        for name, value in (("BLOCK", block), ("QUERIES", queries), ("SEED", seed)):
            monkeypatch.setattr(nearest, name, value)
        got = nearest.top_k(table, F.col("id") % 10 == 0, k)
        assert sorted(map(tuple, got.select("query_id", "rank", "id", "score").collect())) == sorted(want(k))
    assert nearest.top_k(table.limit(0), F.col("id") % 10 == 0).count() == 0


def test_blocks_of_queries_are_shuffled_narrow(spark):
    """Every block of queries goes to every group of candidates, which no broadcast holds; components take no more bytes than they need."""
    table = spark.createDataFrame([(i, [i % 7 - 3, i % 5, -64]) for i in range(900)] + [(900 + i, []) for i in range(5)], "id long, x array<long>")
    got = nearest.top_k(table, F.col("id") % 20 == 0, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    for most, item in ((127, 1), (128, 2), (1 << 15, 4), (1 << 31, 8)):
        batch = pa.RecordBatch.from_pydict({"id": [4, 5], "x": [[most, 0, -1], [2]], "floor": [-np.inf, 1.0]})
        row = next(nearest._packer(8)([batch])).to_pylist()[0]
        assert row["item"] == item and len(row["x"]) == 6 * item
        ids, x = nearest._unpacked(row, 4)
        assert ids.tolist() == [4, 5] and x.dtype == np.int64 and x.tolist() == [[most, 0, -1, 0], [2, 0, 0, 0]]
    empty = nearest.top_k(table.where("id >= 900"), F.col("id") == 900, 2)
    assert [tuple(r) for r in empty.orderBy("rank").collect()] == [(900, 1, 901, 0), (900, 2, 902, 0)]


def test_whole_numbers(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.01]), (2, None), (3, [None]), (4, [float("nan")]), (5, [])], "i int, x array<float>")
    assert [r[0] for r in rows.orderBy("i").select(nearest.whole_numbers("x", 64.0)).collect()] == [[32, -1], None, None, None, []]
