import math

from phraseworks.llm import distinct, queries
from tests.conftest import rows

PHRASES = "phrase_id bigint, topic_key bigint, phrase_rank int, text string, df_ratio double, score string"


def test_top_phrases(spark):
    data = [
        (1, 1, 1, "Common", 0.5, None), (1, 1, 1, "Common", 0.5, None), (2, 1, 2, "shared two", 0.5, None), (3, 1, 3, "ｓｈａｒｅｄ  two", 0.5, None), (4, 1, 4, "alone", 0.9, None), (5, 1, 5, "shared three", None, None),
        (6, 2, 1, "common", 1.5, None), (7, 2, 2, "Shared Two", -0.1, None), (8, 2, 3, "shared three", 1.0, None), (9, 3, 1, "common", float("nan"), None), (10, 3, 2, None, 0.5, None), (11, None, 1, "common", 0.5, None),
    ]
    phrases = spark.createDataFrame(data, PHRASES)
    topics = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "topic_key bigint")
    got = rows(distinct.top_phrases(phrases, topics).select("topic_key", "rank", "phrase_id", "score"))
    # the common phrase is held by 3 of 4 topics, the shared ones by 2
    assert got == [(1, 1, 2, 0.5 * math.log(4 / 2)), (1, 2, 3, 0.5 * math.log(4 / 2)), (1, 3, 1, 0.5 * math.log(4 / 3)), (2, 1, 8, math.log(4 / 2))]
    assert distinct.top_phrases(phrases.where("false"), topics).count() == 0


def neighbours(words, window):
    near = {}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + window]:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    return {k: len(v) for k, v in near.items()}


def test_graph_of_words_equals_brute_force(spark):
    texts = {1: "a b c a d b".split(), 2: ["a"], 3: [], 4: ["x", "x", "x"], 5: "the quick a b".split()}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(6, None, 1)], "record bigint, words array<string>, degree int")
    got = {(r["record"], r["word"]): r["degree"] for r in distinct.degrees(df).collect()}
    assert got == {(k, w): n for k, v in texts.items() for w, n in neighbours(v, distinct.WINDOW).items()}
    scored = {(r["record"], r["word"]): r["score"] for r in distinct.graph_of_words(df, 6).collect()}
    assert abs(scored[1, "a"] - 3 * math.log(6 / 2)) < 1e-12 and scored[5, "quick"] is None


def test_pieces_of_a_record_join(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (1, ["a", "b"])], "record bigint, words array<string>")
    assert rows(distinct.degrees(df)) == [(1, "a", 1), (1, "b", 2), (1, "c", 1)]


def test_words_alone_count_in_n(spark, tmp_path):
    data = [(1, 1, 1, "pump seal", 0.5), (2, 2, 1, "pump", 0.5), (3, 2, 2, "seal", 0.5), (4, 3, 1, "pump report", 0.5), (5, 4, 1, "only", 0.5)]
    spark.createDataFrame(data, "phrase_id bigint, topic_key bigint, phrase_rank int, text string, df_ratio double").write.parquet(f"{tmp_path}/phrase_rows.parquet")
    spark.createDataFrame([(k,) for k in range(1, 6)], "topic_key bigint").write.parquet(f"{tmp_path}/topics_local.parquet")
    got = rows(queries.QUERIES["p5_graph_of_words"](spark, str(tmp_path)).select("topic_key", "word", "degree", "n", "score"))
    pump, seal = math.log(5 / 3), math.log(5 / 2)
    assert got == [(1, "pump", 1, 3, pump), (1, "seal", 1, 2, seal), (2, "pump", 0, 3, 0.0), (2, "seal", 0, 2, 0.0), (3, "pump", 1, 3, pump), (3, "report", 1, 1, None), (4, "only", 0, 1, None)]
