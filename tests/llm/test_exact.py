"""Exact dedup against a plain dictionary, with hot groups, ties, nulls and clashing names."""

import hashlib
import re

from sparsetab.llm import exact


def decided(rows):
    """Group size, winner's id and length for each text without white space."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {key: (len(g), min(g)[3], -min(g)[0]) for key, g in groups.items()}


def rows_of():
    rows = [(i, f"hot  text{' ' * (i % 7)}") for i in range(400)]  # a third of all rows
    rows += [(1000 + i, f"text {i // 3}" + "\n" * (i % 2)) for i in range(600)]
    rows += [(5000, None), (5001, ""), (5002, " \t\r\n\x0b\x0c"), (5003, "é x"), (5004, "é  x"), (5005, "a" * 300_000), (5006, "a " * 300_000)]
    return rows + [(None, "lone"), (None, "pair of nulls"), (None, "pair of nulls"), (7, "twice"), (7, "twice"), (None, "text 0 "), (9, "x y"), (8, "xy ")]


def test_mark(spark, monkeypatch):
    rows = rows_of()
    want = decided(rows)
    for salts, counters in ((64, 128), (1, 1024), (2, 8)):  # many, all and hardly any digests are frequent
        monkeypatch.setattr(exact, "SALTS", salts)
        monkeypatch.setattr(exact, "COUNTERS", counters)
        docs = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], "doc_id long, text string, digest string, row int, best int").repartition(5)
        got = exact.mark(docs)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        got = got.collect()
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        assert len(got) == len(rows)
        assert all((r.group_size, r.keep_id) == by_hash[r.text_sha256][:2] for r in got)
        kept = {}
        for r in got:
            if r.kept:
                assert r.doc_id == r.keep_id and r.text_sha256 not in kept
                kept[r.text_sha256] = r.doc_id
        assert kept == {k: v[1] for k, v in by_hash.items()}


def test_deduplicated(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, doc int, digest string")
    left = exact.deduplicated(docs.repartition(4))
    assert left.columns == docs.columns
    got = {re.sub(r"[\x20\x09-\x0d]", "", r.text or ""): (r.doc_id, len(r.text or "")) for r in left.collect()}
    assert left.count() == len(got) and got == {k: v[1:] for k, v in decided(rows).items()}


def test_frequent_digests_are_found(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    keys = exact._keys(docs, "doc_id", "text")
    found = {r.digest for r in exact.candidates(keys).collect()}
    assert hashlib.sha256(b"hottext").hexdigest() in found and len(found) <= exact.SALTS * exact.COUNTERS


def test_native_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.mark(docs).count() == 0 and exact.deduplicated(docs).count() == 0
    for result in (exact.mark, exact.deduplicated):
        plan = result(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
