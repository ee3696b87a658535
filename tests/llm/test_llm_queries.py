"""The queries on the smallest tables: SQL twins, columns, held-out accuracy."""

import duckdb
import pytest
from conftest import SF
from test_queries import TABLES, plain

from sparsetab.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["doc_id", "held_out", "lang_pred", "score"],
    "op5": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["vec_id", "n_links", "component_id", "kept"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "n_pieces", "ids", "lossless"],
    "op10": ["query_id", "rank", "vec_id", "score"],
    "op11": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op12": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(name.split("_")[0] for name in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name.split("_")[0]]
    names = sorted(got.columns)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(plain(row[columns.index(n)]) for n in names) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(row[n]) for n in names) for row in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name.split("_")[0]]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    if "score" in got.columns:
        assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    if "lossless" in got.columns:
        assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows)
