import pytest
from pyspark.sql import functions as F

from phraseworks.llm import mixing
from tests.conftest import rows

pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, source string, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark):
    sources = ["big", " BIG ", "small", "Two-Words", None, "untargeted"]
    data = [(i, " ".join(["word"] * (1 + i % 17)), sources[max(0, i % 10 - 4)], "x") for i in range(3000)] + [(9001, None, "small", "x"), (9002, "", "big", "x")]
    return spark.createDataFrame(data, DOCS)


def test_shares(spark):
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("two_words", 0.1, 1), ("absent", 0.1, 5), (None, 0.5, 1)], TARGETS)
    selection, report = mixing.mixed(documents(spark), targets)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "small", "two_words", "absent", "untargeted", None}
    for s, share in (("big", 0.5 / 0.9), ("small", 0.3 / 0.9), ("two_words", 0.1 / 0.9)):
        assert abs(got[s]["actual_share"] - share) < 0.02, s
    assert got["absent"]["mixed_tokens"] == got["untargeted"]["mixed_tokens"] == got[None]["mixed_tokens"] == 0
    # expected tokens meet the targets closely before rounding
    exact = {r["source"]: r["t"] for r in selection.groupBy("source").agg(F.sum(F.col("rate") * F.col("tokens")).alias("t")).collect()}
    total = sum(exact.values())
    assert abs(exact["big"] / total - 0.5 / 0.9) < 1e-6
    caps = {"big": 2, "small": 3, "two_words": 1}
    assert all(r["copies"] <= caps[r["source"]] for r in selection.collect())
    assert any(got[s]["most_copies"] == c for s, c in caps.items())
    again, _ = mixing.mixed(documents(spark).repartition(7), targets)
    assert rows(again.select("doc_id", "copies")) == rows(selection.select("doc_id", "copies"))


def test_given_size_and_edges(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), ("big", None, None), ("small", -1.0, 3)], TARGETS)
    _, report = mixing.mixed(documents(spark), targets, size=1000.0)
    got = {r["source"]: r["mixed_tokens"] for r in report.collect()}
    assert 800 < got["big"] < 1200 and got["small"] == 0
    selection, report = mixing.mixed(documents(spark), targets.where("false"))
    assert selection.count() == 0 and report.where("mixed_tokens > 0").count() == 0
    selection, report = mixing.mixed(documents(spark).where("false"), targets)
    assert selection.count() == 0 and report.count() == 2


def test_whole_texts_are_counted(spark):
    df = spark.createDataFrame([(1, "word " * 50_000, "s"), (2, None, None)], "doc_id bigint, text string, source string")
    assert rows(mixing.token_counts(df).select("doc_id", "source", F.col("tokens") >= 50_000)) == [(1, "s", True), (2, None, False)]


def test_rounding_is_systematic(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("two_words", 0.2, 1)], TARGETS)
    selection, report = mixing.mixed(documents(spark), targets)
    for r in report.where("target_share > 0").collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.005 * r["target_share"] + 1e-4, r
    for r in selection.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum("rate").alias("rate"), F.max(F.abs(F.col("copies") - F.col("rate"))).alias("off")).collect():
        assert abs(r["copies"] - r["rate"]) < 1.01 and r["off"] < 1


def test_what_cannot_be_met_is_an_error(spark, monkeypatch):
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 3)], TARGETS)
    with pytest.raises(ValueError, match="at most"):
        mixing.mixed(documents(spark), targets, size=1e9)
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.mixed(documents(spark), targets, size=5000.0)
