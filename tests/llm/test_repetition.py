import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from phraseworks.llm import repetition
from phraseworks.llm.leakage import words_of
from tests.conftest import rows


def brute(text):
    w = words_of(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len(runs), len(runs) - len(set(runs))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é", max_size=60)), max_size=6))
def test_runs_equal_brute_force(texts):
    runs = repetition.Runs(texts, repetition.WordHashes())
    again = [int(runs.again[runs.doc == i].sum()) for i in range(len(texts))]
    assert [(int(n), k) for n, k in zip(runs.counts, again, strict=True)] == [brute(t) for t in texts]


def test_share_and_ratio(spark):
    base = "one two three four five six seven"
    data = [(1, base), (2, f"{base} {base}"), (3, None), (4, ""), (5, "four words only here"), (6, "spam " * 50_000), (7, f"{base} unlike words follow now {base[:27]}"), (8, base)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, llr string")
    got = {r["doc_id"]: r for r in repetition.scored(df).collect()}
    assert {k: (r["n_runs"], r["n_repeated"]) for k, r in got.items()} == {k: brute(t) for k, t in data}
    assert got[2]["repeated_share"] == 3 / 10 and got[3]["repeated_share"] == 0.0
    assert all(got[k]["llr"] > 0 for k, r in got.items() if r["n_repeated"])
    assert got[5]["llr"] == 0.0
    assert rows(repetition.repetitive(df).select("doc_id")) == [(2,), (6,)]
    # few buckets: every ratio is above 0, the exact share decides
    assert rows(repetition.repetitive(df.repartition(3)).select("doc_id")) == [(2,), (6,)]
    assert repetition.repetitive(df.where("false")).count() == 0


def test_multinomials(spark):
    df = spark.createDataFrame([("a b c d e a b c d e",), ("a b c d e",), (None,)], "text string")
    got = repetition.multinomials(df, 1 << 16)
    assert sorted((r["raw"], r["target"]) for r in got.collect()) == [(1, 1)] * 4 + [(3, 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=80), min_size=1, max_size=5))
def test_the_ratio_bounds_the_share(texts):
    runs = repetition.Runs(texts, repetition.WordHashes())
    for text, llr in zip(texts, runs.ratio(), strict=True):
        n, k = brute(text)
        w = words_of(text)
        counts = Counter(tuple(w[i : i + 5]) for i in range(n))
        assert abs(llr - sum(c * math.log(c) for c in counts.values()) / max(n, 1)) < 1e-9
        assert k == n == 0 or llr >= -math.log(1 - k / n) - 1e-9
        assert not n or k * 10 < n * 3 or llr >= repetition.threshold(3)


def test_the_ratio_decides_and_the_share_checks(spark, monkeypatch):
    once = " ".join(f"w{i}" for i in range(400))
    data = [(1, f"{once} {'spam ' * 120}"), (2, f"{once} {once}"), (3, once)]  # 1: high ratio, low share
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in repetition.scored(df).collect()}
    assert got[1]["llr"] > repetition.threshold(3) and got[1]["repeated_share"] < 0.3
    assert rows(repetition.repetitive(df).select("doc_id")) == [(2,)]
    monkeypatch.setattr(repetition, "threshold", lambda tenths: 1.0)
    assert rows(repetition.repetitive(df).select("doc_id")) == []
