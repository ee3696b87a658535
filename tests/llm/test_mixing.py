"""Targets against a loop that reshares, the draw against plain Python."""

import hashlib
import math

from sparsetab.llm import mixing

SCHEMA = "row long, source string, size long, quality double"


def reshared(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, None: 500}, {"é": 0, "z": 0}, {"a": 5, "B": 50, "c": 0, "d": 7, "e": 10000, "f": 3, "g": 90}, {"x": 9}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
        want = reshared(sizes, (1.0, 2.0, 3.0), 3)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def draw(rows, seed="mix", most=3):
    sizes = {}
    for _, source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
    target, out = reshared(sizes, (1.0, 2.0, 3.0), most), []
    for source in sizes:
        def key(r):
            text = seed + "\x01" + ("\x02" if r[0] is None else str(r[0]))
            u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return (-math.log(u) / (r[3] if r[3] and r[3] > 0 else 1.0), r[0] is not None, r[0] or 0, r[2])
        whole = min(math.floor(target[source] / sizes[source]), most) if sizes[source] else 0
        budget, before = max(target[source] - whole * sizes[source], 0.0), 0
        for r in sorted((r for r in rows if r[1] == source), key=key):
            out.append((r[0], source, r[2], whole + (whole < most and before + r[2] / 2 <= budget)))
            before += r[2]
    return sorted(out, key=repr)


def rows_of(n):
    rows = [(i, f"s{i % 7}" if i % 5 else "s0", (i * 37) % 90, (None, 2.0, 0.5, -1.0)[i % 4]) for i in range(n)]
    return rows + [(None, "s0", 10, 1.0), (n, None, 40, None), (n + 1, None, 0, 2.0), (5, "s5", 185 % 90, 2.0), (n + 2, "long", 100000, 1.0), (n + 3, "void", 0, None)]


def test_draw(spark, monkeypatch):
    rows = rows_of(400)
    for cells, wide in ((2000, 1000), (10, 3)):  # few and many cells give the same result
        monkeypatch.setattr(mixing, "CELL_ROWS", cells)
        monkeypatch.setattr(mixing, "CELLS_OF_CELLS", wide)
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", target int, _key int")
        got = mixing.mix(docs)
        assert sorted(((r["row"], r["source"], r["size"], r["copies"]) for r in got.collect()), key=repr) == draw(rows)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(rows_of(20), SCHEMA)
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_sizes_and_empty(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (4, "a b\x0bc d"), (5, "x " * 5000)], "i int, text string")
    assert [r[0] for r in texts.orderBy("i").select(mixing.n_words("text")).collect()] == [0, 0, 0, 3, 5000]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_without_an_id_draw_by_their_text(spark):
    """A budget between two whole passes takes some documents without an id and leaves others."""
    rows = [(None, s, 10, None, f"{s}{i}") for s in "abc" for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA + ", tie string")
    got = mixing.mix(docs, tie="tie").collect()
    assert len(got) == len(rows) and {r["copies"] for r in got if r["source"] == "a"} == {0, 1}
    assert mixing.mix(docs, tie="tie").columns == ["row", "source", "size", "quality", "source_size", "target", "copies"]
