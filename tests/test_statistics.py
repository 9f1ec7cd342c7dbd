import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phraseworks import queries
from phraseworks.operators import boilerplate, cooccurrence, identifiers, selection, stopwords, terms, topics, vectors, whitelist
from phraseworks.plans import render, writer
from tests.conftest import rows

DOCS = [(0, "The pump was sealed. The pump, sealed!"), (1, "pump report"), (2, "عينة، pump"), (3, ""), (4, None)]


def frame(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def brute(text):
    k = re.findall(r"[A-Za-z0-9؀-ۿ]+", (text or "").lower())
    return [" ".join(k[i : i + n]) for n in (1, 2, 3) for i in range(len(k) - n + 1)]


def test_counts_equal_brute_force(spark):
    want = sorted(((d, t, n) for d, x in DOCS for t, n in Counter(brute(x)).items()), key=repr)
    assert rows(terms.doc_term_counts(frame(spark))) == want
    assert rows(terms.doc_term_counts(frame(spark).repartition(3))) == want


def test_stats_and_top(spark):
    docs = terms.readable(frame(spark))
    stats = terms.term_stats(terms.doc_term_counts(docs), 3)
    got = {r["term"]: (r["tf"], r["df"], r["df_ratio"]) for r in stats.collect()}
    assert got["pump"] == (4, 3, 1.0) and got["the pump"] == (2, 1, 1 / 3)
    top = sorted(terms.top_terms(stats, docs, 6).collect(), key=lambda r: r["rank"])
    # df, then tf, then first seen: words of document 0 in order, then its pairs
    assert [r["term"] for r in top] == ["pump", "the", "sealed", "the pump", "was", "pump was"]
    assert terms.top_terms(stats.where("false"), docs, 5).count() == 0
    assert terms.table_markdown(terms.top_terms(stats, docs, 1)).first()["md"] == "Term | TF | DF | DF%\n---|---:|---:|---:\npump | 4 | 3 | 100%"


def test_tfidf_is_normalised(spark):
    docs = terms.readable(frame(spark))
    counts = terms.doc_term_counts(docs)
    w = vectors.tfidf(counts, vectors.vocabulary(terms.term_stats(counts, 3)), 3)
    assert all(abs(r["n"] - 1) < 1e-12 for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    vocab = vectors.vocabulary(terms.term_stats(counts, 3))
    words = sorted(r["term"] for r in vocab.collect())
    sparse = {(r["doc_id"], words[i]): x for r in vectors.document_vectors(docs, vocab, 3).collect() for i, x in zip(r["features"].indices, r["features"].values, strict=True)}
    assert {k: round(x, 12) for k, x in sparse.items()} == {(r["doc_id"], r["term"]): round(r["weight"], 12) for r in w.collect()}
    assert vectors.topic_count(5, 8) == 3 and vectors.aux_topic_count(2, 8) == 1 and vectors.aux_topic_count(10, 8) == 4


def test_mined_terms_bridge_stopwords(spark):
    got = {r["term"] for r in terms.mine_terms(frame(spark), ["was", "the"], 3).collect()}
    assert "pump sealed" in got and "the" not in got and "was" not in got


def test_only_term_statistics_are_capped(spark):
    docs = spark.createDataFrame([(1, "aa " * terms.MAX_TOKENS + "tail")], "doc_id bigint, text string")
    assert {r["term"]: r["tf"] for r in terms.mine_terms(docs, [], 1, n_max=1).collect()} == {"tail": 1}
    whole = terms.doc_term_counts(docs, 1)
    assert rows(whole) == [(1, "aa", terms.MAX_TOKENS), (1, "tail", 1)]
    assert rows(terms.doc_term_counts(docs, 1, cap=terms.MAX_TOKENS)) == [(1, "aa", terms.MAX_TOKENS)]
    vocab = vectors.vocabulary(terms.term_stats(whole, 1))
    assert vectors.document_vectors(docs, vocab, 1, n_max=1).first()["features"].numNonzeros() == 2


def test_boilerplate(spark):
    repeated = [f"line with number {i}" for i in range(5)]
    text = "\n".join(["Acme report page 1 of 3", "Acme report page 2 of 3", "Acme report page 3 of 3", "Document Control sheet", "short", *(f"{x} text {'abcdefghij'[i]}" for i, x in enumerate(repeated))])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "only this line")], "doc_id bigint, text string")
    found = rows(boilerplate.boilerplate_lines(docs).select("line"))
    assert found == [("Acme report page 1 of 3",), ("Acme report page 2 of 3",), ("Acme report page 3 of 3",), ("Document Control sheet",)]
    cleaned = {r["doc_id"]: r["cleaned"] for r in boilerplate.cleaned(docs).collect()}
    assert cleaned[2] == "" and cleaned[3] == "only this line" and "short" not in cleaned[1] and cleaned[1].startswith("line with number 0")


def test_stopwords(spark, tmp_path):
    (tmp_path / "s.txt").write_text("﻿# comment\nThe\n\n the \nمن\n", encoding="utf-8")
    assert rows(stopwords.load(spark, str(tmp_path / "s.txt"))) == [("the",), ("من",)]
    stats = spark.createDataFrame([("a", 0.1), ("common", 0.9), ("rare term", 0.2), ("abc", 0.5)], "term string, df_ratio double")
    assert {"a", "common", "notice"} <= {r[0] for r in rows(stopwords.from_stats(stats))} and ("abc",) not in rows(stopwords.from_stats(stats))
    assert rows(stopwords.heuristic_exclude(stats)) == [("a",), ("abc",), ("common",)]
    lists = (spark.createDataFrame([("a",), ("abc",)], "term string"), spark.createDataFrame([("a",)], "term string"))
    assert {r["term"]: r["decision"] for r in stopwords.review(stats, *lists).collect()} == {"a": "exclude", "common": None, "rare term": None, "abc": "include"}


def cooc(spark):
    """Four documents of one topic: which of the phrases 0..3 each has."""
    present = spark.createDataFrame([(0, d, i) for d, ids in enumerate([(0, 1), (0, 1, 2), (1,), (0, 2)]) for i in ids], "label int, doc_id bigint, idx int")
    phrases = spark.createDataFrame([(0, i, p) for i, p in enumerate(["alpha", "beta", "gamma", "delta"])], "label int, idx int, phrase string")
    return present, phrases, spark.createDataFrame([(0, 4)], "label int, n bigint")


def test_cooccurrence(spark):
    present, phrases, sizes = cooc(spark)
    df, pairs = cooccurrence.phrase_df(present, phrases), cooccurrence.pair_df(present)
    assert rows(df) == [(0, 0, 3), (0, 1, 3), (0, 2, 2), (0, 3, 0)]
    assert rows(pairs) == [(0, 0, 1, 2), (0, 0, 2, 2), (0, 1, 2, 1)]
    lift = {(r["i"], r["j"]): r["lift"] for r in cooccurrence.lift(df, pairs, sizes).collect()}
    assert lift[0, 2] == 0.5 / (0.75 * 0.5)
    assert rows(cooccurrence.anchors(phrases, df, sizes).select("rank", "phrase")) == [(1, "gamma"), (2, "beta"), (3, "alpha")]
    assert rows(cooccurrence.groups(phrases, df, pairs, sizes).select("group", "rank", "phrase")) == [(1, 1, "gamma"), (1, 2, "beta"), (1, 3, "alpha")]
    # without anchors the first phrases stand in
    none = cooccurrence.groups(phrases, df.withColumn("df", F.lit(0).cast("bigint")), pairs, sizes)
    assert rows(none.select("group", "rank", "phrase")) == [(1, 1, "alpha"), (1, 2, "beta"), (1, 3, "gamma"), (1, 4, "delta")]


def test_presence_uses_word_boundaries(spark):
    docs = spark.createDataFrame([(1, "the PO, support"), (2, "support only"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id bigint, label int")
    phrases = spark.createDataFrame([(0, 0, "po"), (0, 1, "support"), (0, 2, "a.c \\E x")], "label int, idx int, phrase string")
    assert rows(cooccurrence.presence(docs, labels, phrases)) == [(0, 1, 0), (0, 1, 1), (0, 2, 1)]


def test_shape_and_whitelist(spark):
    assert whitelist.shaped([["a b", "b c"], ["c"]]) == []
    assert whitelist.shaped([["aa", "AA", "bb"], ["cc", "dd"]]) == [["aa", "bb"], ["cc", "dd"]]
    offered = whitelist.allowed_map(["Work  Permit", "work permit", "a b c d", "ab", "site visit"])
    assert offered == {"work permit": "Work Permit", "site visit": "site visit"}
    assert whitelist.canonical("WORK PERMIT", offered, []) == "Work Permit"
    assert whitelist.canonical("WORK PERMIT", offered, ["work permit"]) is None
    assert whitelist.clean_groups([["nope"]], [["work permit", "site visit"], ["x y", "site visit"]], offered, []) == [["Work Permit", "site visit"], ["x y", "site visit"]]
    df = spark.createDataFrame([(1, "Work  Permit"), (2, "work permit"), (3, "a b c d"), (4, "ab")], "pos bigint, phrase string")
    assert rows(whitelist.allowed(df)) == [("work permit", "Work Permit")]
    got = whitelist.enforce(df, whitelist.allowed(df), spark.createDataFrame([("other",)], "phrase string"))
    assert rows(got.select("pos", "canonical")) == [(1, "Work Permit"), (2, "Work Permit")]
    assert whitelist.enforce(df, whitelist.allowed(df), spark.createDataFrame([("WORK permit",)], "phrase string")).count() == 0


def test_penalty_and_selection(spark):
    assert selection.penalty([["a", "b"], ["c", "d", "e"]], {}) == 1.0 and selection.penalty([["a"]], {}) == 999.0
    stats = spark.createDataFrame([("a", 0.9), ("b", 0.7)], "term string, df_ratio double")
    groups = spark.createDataFrame([(1, [["a", "b"], ["c", "d", "e"]]), (2, [["a"]]), (3, [["x"], ["y", "z", "w"]])], "rule_id int, groups array<array<string>>")
    assert rows(selection.penalties(groups, stats)) == [(1, 4.0), (2, 999.0), (3, 2.0)]
    # rules {0,1}, {2}, {} with costs 1, 9, 0: the third is best after the first but adds nothing
    assert selection.select_rules({0b001: 2, 0b010: 1}, [1, 9, 0], 3, 1) == [0]
    assert selection.select_rules({0b001: 2, 0b010: 1}, [1, 9, 0], 3, 3) == [0, 1, 2]
    assert selection.select_rules({}, [0.0], 0, 1) == [0]


def test_identifiers(spark):
    assert [x["name"] for x in identifiers.suggest([])] == ["Invoice number", "PO number", "Work Permit", "MSA agreement id"]
    assert [x["name"] for x in identifiers.suggest(["report"])] == ["PO number"]
    docs = spark.createDataFrame([("INV-2024-12345 and PO-12345 PO-123456",), (None,), ("PO-1",)], "text string")
    got = {r["name"]: (r["docs"], r["hits"]) for r in identifiers.pattern_counts(docs).collect()}
    assert got["PO number"] == (1, 2) and got["Invoice number"] == (1, 1) and got["Vendor ID"] == (0, 0)


def test_rendering():
    assert render.all_of([["a", "b"], ["c"], [" "]]) == '(("a" OR "b") AND "c")'
    assert render.any_clause([[["a"]], [["b"], ["c"]]]) == '("a" OR ("b" AND "c"))'
    groups = [{"terms": ["a", 'b"'], "match": "OR"}, {"terms": ["c", "d"], "match": "AND"}, {"terms": []}]
    assert render.near_expression(groups) == '(("a" OR "b") NEAR/10 ("c" AND "d"))'
    assert render.near_expression(groups[:1]) == '("a" OR "b")'
    long = render.long_markdown([{"title": "T", "intent": "i", "logic": "l", "phrases": ["p|q"]}], ["b", "a", "a"], [], "2024-01-01 00:00")
    assert "### Rule 1: T" in long and "p\\|q" in long and "a, b" in long
    made = render.payload([{"term": "x"}] * 90, ["b", "a", "a"], [], groups, 10, 2)
    assert made["keyword_list_include"] == ["a", "b"] and len(made["debug"]["top_terms"]) == 80


def test_writers(tmp_path):
    assert writer.read_json('noise {"a": 1} noise') == {"a": 1}
    generic, names, phrases = writer.topic_refinement({"generic_terms": [" x ", ""], "topics": [{"old_name": "Topic 1", "new_name": "**New**", "phrases": [{"p": " a  b "}, {"p": ""}]}, {"new_name": "lost"}]})
    assert (generic, names, phrases) == (["x"], {"Topic 1": "New"}, {"Topic 1": ["a b"]})
    (tmp_path / "write_rules.json").write_text('```\n{"rules": []}\n```')
    assert writer.JsonFixtureWriter(str(tmp_path)).write_rules({}) == {"rules": []}
    asked = writer.stopword_payload([{"term": "t", "df_ratio": 0.91234, "score": 1}, {"term": " "}], ["l"] * 20)
    assert asked["candidate_terms"] == [{"term": "t", "df_ratio": 0.912, "score": 1.0, "kind": "general"}] and len(asked["boilerplate_examples"]) == 12
    assert writer.DeterministicWriter().refine_stopwords(asked)["stopwords"] == ["t"]


def test_inferred_topics(spark):
    docs = spark.createDataFrame([(i, f"pump seal ppm ppm {'report work permit' if i % 2 else 'invoice bank transfer'} ref{1000 + i}") for i in range(8)], "doc_id bigint, text string")
    found = topics.infer_topics(docs, ["report"], max_topics=2)
    assert sorted(r["n"] for r in found.sizes.collect()) == [4, 4]
    listed = {r["phrase"] for r in found.phrases.collect()}
    assert "work permit" in listed and "invoice bank" in listed and "ppm ppm" not in listed and "report" not in listed and "ref1000" not in listed
    assert topics.infer_topics(docs.limit(1), [], low=0.0, high=1.0).sizes.count() == 1


def test_inferred_topics_cluster_by_all_terms(spark):
    common = " ".join(f"w{i}" for i in range(25_000))  # of higher tf than what tells the documents apart
    docs = spark.createDataFrame([(i, f"{common} {common} {' '.join(['pump seal' if i % 2 else 'invoice bank'] * 3)} only{i}") for i in range(6)], "doc_id bigint, text string")
    found = topics.infer_topics(docs, [], max_topics=2, n_max=1)
    assert sorted(r["n"] for r in found.sizes.collect()) == [3, 3]


def test_weight_vectors_keep_all_distances(spark):
    weights = {0: {"a": 0.6, "b": 0.8}, 1: {"a": 1.0}, 2: {"b": 0.3, "c": 0.4, "d": 0.5}, 3: {}}
    df = spark.createDataFrame([(d, t, w) for d, x in weights.items() for t, w in x.items()], "doc_id bigint, term string, weight double")
    got = {r["doc_id"]: r["features"] for r in vectors.weight_vectors(df, spark.createDataFrame([(d,) for d in weights], "doc_id bigint")).collect()}
    for a, x in weights.items():
        for b, y in weights.items():
            assert abs(got[a].squared_distance(got[b]) - sum((x.get(t, 0) - y.get(t, 0)) ** 2 for t in "abcd")) < 1e-12


def test_whole_inference_is_a_query(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    found = queries.QUERIES["inferred_topics_kmeans"](spark, folder).groupBy("label").agg(F.max("rank").alias("n")).collect()
    assert len(found) > 1 and max(r["n"] for r in found) == topics.AUX_KEEP


def test_topics(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2)], "doc_id bigint, label int")
    assert rows(topics.topic_sizes(labels, 2).select("rank", "label", "n")) == [(1, 1, 2), (2, 0, 1)]
    stats = spark.createDataFrame([("alpha", 0.5), ("beta", 0.5), ("123", 0.5), ("ab", 0.5), ("every", 0.95)], "term string, df_ratio double")
    centroids = spark.createDataFrame([(0, x, 0.5) for x in ("alpha", "beta", "123", "ab", "every")], "label int, term string, weight double")
    found = topics.candidates(centroids, stats)
    assert rows(found.select("rank", "phrase")) == [(1, "beta"), (2, "alpha")]
    shown = topics.previews(topics.topic_sizes(labels, 3), found).where("label = 0").first()
    assert (shown["topic_name"], shown["doc_count"], [p["text"] for p in shown["phrases"]]) == ("Topic 1", 1, ["beta", "alpha"])
