"""How often the queries read the corpus and what they shuffle."""

from pathlib import Path

import pytest

from phraseworks import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plan(spark, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "scans"), [("tfidf_weights", 2), ("tfidf_column_sums", 2), ("boilerplate_lines", 1), ("boilerplate_counts", 1), ("cleaned_text", 1), ("cooc_presence", 2), ("test_policy_flat", 1), ("phrase_equi_match", 1), ("topic_members", 1)])
def test_scans(spark, name, scans):
    assert plan(spark, name)[1].count("FileScan parquet") == scans


@pytest.mark.parametrize("name", ["boilerplate_lines", "cleaned_text", "test_policy_flat", "topic_members", "combined_expression", "regex_suggestions"])
def test_nothing_is_shuffled(spark, name):
    assert "Exchange" not in plan(spark, name)[2]

