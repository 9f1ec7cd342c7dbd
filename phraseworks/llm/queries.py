"""Queries of the training-data problems, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseworks.llm import clusters, distinct, glyphs, leakage, mixing, oracles, pii, repetition, terms
from phraseworks.llm.once import once
from phraseworks.session import cut_lineage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_term_frequencies(spark, d).where("mark is not null").select("term", "mark")


def p1_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "term_rows"), table(spark, d, "analyze_runs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_topic_clusters(spark, d).where("first_key <> topic_key")


def p2_topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    made = clusters.topic_clusters(table(spark, d, "topics_local"), table(spark, d, "phrase_rows"))
    return made.select(F.col("cluster").alias("first_key"), "topic_key")


def p2_described(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size in topics and documents, a name, and its most typical topics."""
    made = clusters.describe_topics(table(spark, d, "topics_local"), table(spark, d, "topic_previews"), table(spark, d, "phrase_rows"))
    return made.withColumn("typical", F.array_join(F.transform("typical", lambda x: x.cast("string")), ","))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "session_docs"), table(spark, d, "person_names"))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every uploaded text once, with typed placeholders."""
    return pii.masked(once(table(spark, d, "session_docs").select("doc_id", "text", "loaded_at"), "doc_id", "loaded_at"), table(spark, d, "person_names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = glyphs.inconsistent_rows(table(spark, d, "session_docs"), "doc_id", "text")
    phrases = glyphs.inconsistent_rows(table(spark, d, "phrase_rows"), "phrase_id", "text")
    return docs.select(F.lit("session_docs").alias("tbl"), "row_id").unionAll(phrases.select(F.lit("phrase_rows").alias("tbl"), "row_id"))


def p4_session_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every uploaded text once, in consistent form."""
    docs = once(table(spark, d, "session_docs").select("doc_id", "text", "loaded_at"), "doc_id", "loaded_at")
    return glyphs.with_consistent_form(docs, "text").select("doc_id", F.col("consistent").alias("text"), "changed")


def p4_phrase_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every topic phrase once, in consistent form, with its key."""
    rows = once(table(spark, d, "phrase_rows").select("phrase_id", "topic_key", "text"), "phrase_id", "topic_key")
    made = glyphs.with_consistent_form(rows, "text")
    return made.select("phrase_id", "topic_key", F.col("consistent").alias("text"), glyphs.phrase_key(F.col("consistent")).alias("phrase_key"), "changed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_top_phrases(spark, d).select("topic_key", "phrase_id")


def p5_top_phrases(spark: SparkSession, d: str) -> DataFrame:
    made = distinct.top_phrases(table(spark, d, "phrase_rows"), table(spark, d, "topics_local"))
    return made.withColumn("score", F.round("score", 9))


def p5_graph_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every topic's phrases by distinct neighbours times rarity."""
    rows = table(spark, d, "phrase_rows")
    total = table(spark, d, "topics_local").select("topic_key").distinct().count()
    keys = cut_lineage(distinct.phrase_rows(rows).select("record", "term").distinct())  # read for the edges, and for the words that stand alone
    phrases = keys.select("record", F.split("term", " ").alias("words"))
    return distinct.graph_of_words(phrases, total, alone=True).withColumnRenamed("record", "topic_key")


def p5_word_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same with scores to nine places, as SQL checks it: the logarithms of two engines may differ in their last digit."""
    return p5_graph_of_words(spark, d).withColumn("score", F.round("score", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mix with its copies."""
    selection, _ = mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return selection.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and actual shares by source."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id")


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.scored(table(spark, d, "documents")).select("doc_id", "n_runs", "n_repeated", F.round("repeated_share", 6).alias("repeated_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_term_frequencies, p2_found, p2_topic_clusters, p2_described, p3_found, p3_masked, p4_found, p4_session_docs, p4_phrase_rows, p5_found, p5_top_phrases, p5_graph_of_words, p5_word_scores, p6_found, p7_selection, p7_shares, p8_found, p8_repetition)
}

_P1 = r"""
WITH clean AS (
  SELECT run_id, lower(regexp_replace(term, '^\s+|\s+$', '', 'g')) AS term, tf, df, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS loaded
  FROM term_rows WHERE term IS NOT NULL AND tf IS NOT NULL AND df IS NOT NULL),
last AS (
  SELECT run_id, term, max(tf) AS tf, max(df) AS df FROM clean c
  WHERE loaded = (SELECT max(loaded) FROM clean x WHERE x.run_id = c.run_id AND x.term = c.term) GROUP BY 1, 2),
n AS (SELECT sum(n) AS n FROM (SELECT run_id, arg_max(n_docs, loaded_at) AS n FROM analyze_runs GROUP BY 1)),
t AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(df) AS BIGINT) AS df FROM last GROUP BY 1),
m AS (SELECT term, tf, df, df / n AS df_ratio, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.4::DOUBLE * n THEN 'common' END AS mark FROM t, n)
"""
_P8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS k FROM documents),
r AS (SELECT doc_id, CASE WHEN len(k) >= 5 THEN list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i+4], ' ')) ELSE [] END AS runs FROM w),
c AS (SELECT doc_id, CAST(len(runs) AS BIGINT) AS n_runs, CAST(len(runs) - len(list_distinct(runs)) AS BIGINT) AS n_repeated FROM r)
"""
_P6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS k FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS k FROM eval_items),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(k) - 10), lambda j: array_to_string(k[j:j+11], ' '))) AS w FROM d WHERE len(k) >= 12),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(k) - 10), lambda j: array_to_string(k[j:j+11], ' '))) AS w FROM i WHERE len(k) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)
"""

ORACLE: dict[str, str] = {
    **oracles.ORACLE,
    "p1_found": _P1 + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_term_frequencies": _P1 + "SELECT * FROM m",
    "p6_found": _P6,
    "p8_found": _P8 + "SELECT doc_id FROM c WHERE n_runs > 0 AND n_repeated * 10 >= n_runs * 3",
    "p8_repetition": _P8 + "SELECT doc_id, n_runs, n_repeated, CASE WHEN n_runs > 0 THEN round(n_repeated / n_runs, 6) ELSE 0.0 END AS repeated_share FROM c",
}
