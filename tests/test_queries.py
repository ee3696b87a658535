"""Every query with an SQL twin, on the smallest tables."""

import importlib.util
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from conftest import SF
from sparsetab.operators import relational

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return 0.0 if value == 0 and isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(row[columns.index(n)]) for n in names) for row in result.fetchall()), key=repr)
    have = sorted((tuple(plain(row[n]) for n in names) for row in got.collect()), key=repr)
    assert have == want


@pytest.mark.parametrize("name", ["g2_add_root", "g3_random_costs", "j2_edges_within", "s4_read_tagged_lines", "u1_union", "u3_same_support"])
def test_matches_sql_in_many_tasks(spark, duck, monkeypatch, name):
    monkeypatch.setattr(relational, "TASK_ROWS", 500)
    test_matches_sql(spark, duck, name)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
