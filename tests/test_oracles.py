"""Queries against their SQL on the smallest tables, where these are at hand."""

from pathlib import Path

import pytest

from phraseworks import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
NAMES = ["test_policy_flat", "rule_mask_histogram", "phrase_equi_match", "term_stats", "top_terms", "tfidf_weights", "topic_tfidf_sums", "topic_groups", "boilerplate_counts", "cleaned_text", "mine_terms", "structured_previews"]


def shown(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, duck, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    result = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(shown(r[columns.index(c)]) for c in df.columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(shown, r)) for r in df.collect()), key=repr) == want


def test_every_sql_has_its_query():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    for sql in queries.ORACLE.values():
        assert duckdb.extract_statements(sql)
