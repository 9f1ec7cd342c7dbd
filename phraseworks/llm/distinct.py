"""How distinctive a term is of its record (problem 5): a local weight times rarity in the collection.

Method: graph-of-words weighting. Per record, words within a sliding window are joined by edges; a term's local weight is
its number of distinct neighbours instead of its frequency; the score multiplies that by rarity, ``ln(T / n)``. Rarity is
read from the graph of records and terms: n is the number of distinct neighbours (records) of a term there, by the same
operator that counts the neighbours of words (``neighbours``). Where the caller gives a local weight of its own
(``TopicPreview.phrases`` carry ``df_ratio``, which p5_found prescribes in the score), that replaces the degree.

Defined results: records of fewer than two words have degree 0; terms held by one record only and rows without a usable
local weight are not scored but count in n; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseworks.llm.glyphs import phrase_key, with_consistent_form
from phraseworks.session import cut_lineage

WINDOW = 4


def neighbours(edges: DataFrame, node: Sequence[str], other: str, into: str) -> DataFrame:
    """``(*node, into)``: how many distinct ``other`` each node has in ``edges``; made distinct, then counted, both pre-aggregated."""
    return edges.select(*node, other).distinct().groupBy(*node).agg(F.count("*").alias(into))


def rarity(terms: DataFrame, record: str, term: str, n_records: int) -> DataFrame:
    """``(term, n, rarity)``: the degree of each term in the graph of records and terms, and ``ln(T / n)``."""
    return neighbours(terms, [term], record, "n").withColumn("rarity", F.log(F.lit(float(max(1, n_records))) / F.col("n")))


def degrees(words: DataFrame, record: str = "record", sequence: str = "words", window: int = WINDOW) -> DataFrame:
    """``(record, word, degree)`` of rows ``(record, array of words)``: distinct neighbours within ``window`` words.

    Edges are built inside the row and made distinct before degrees are counted; a record given in several rows (pieces of
    one text) has the union of their edges.
    """
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(window - 1)),
            lambda gap: F.when(
                F.size(sequence) > gap,
                F.zip_with(
                    F.slice(sequence, 1, F.greatest(F.size(sequence) - gap, F.lit(0))),
                    F.slice(sequence, gap + 1, F.greatest(F.size(sequence) - gap, F.lit(0))),
                    lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
                ),
            ).otherwise(F.array().cast("array<struct<a:string,b:string>>")),
        )
    )
    edges = words.where(F.size(sequence) > 1).select(record, F.explode(F.array_distinct(pairs)).alias("e")).where("e.a <> e.b")
    ends = edges.select(record, F.inline(F.array(F.struct(F.col("e.a").alias("word"), F.col("e.b").alias("next")), F.struct(F.col("e.b").alias("word"), F.col("e.a").alias("next")))))
    return neighbours(ends, [record, "word"], "next", "degree")


def distinctiveness(terms: DataFrame, n_records: int, local: Column, record: str = "record", term: str = "term") -> DataFrame:
    """``terms`` with ``n``, ``rarity`` and ``score = local * rarity`` (null where not scored). ``local`` null: not scored."""
    scored = terms.join(rarity(terms, record, term, n_records), term)
    usable = local.isNotNull() & (F.col("n") > 1)
    return scored.withColumn("score", F.when(usable, local * F.col("rarity")))


def graph_of_words(words: DataFrame, n_records: int, window: int = WINDOW, alone: bool = False) -> DataFrame:
    """``(record, word, degree, n, score)`` for records of words: degree times rarity.

    ``alone``: words without a neighbour in their record have degree 0 there and count in n; else only words with edges do.
    """
    weighted = degrees(words, window=window)
    if alone:
        held = words.select("record", F.explode("words").alias("word")).where("word <> ''").distinct()
        weighted = held.join(weighted, ["record", "word"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return distinctiveness(weighted.withColumnRenamed("word", "term"), n_records, F.col("degree").cast("double")).withColumnRenamed("term", "word").select("record", "word", "degree", "n", "score")


def phrase_rows(rows: DataFrame) -> DataFrame:
    """PhraseRows with their key: ``(phrase_id, record, phrase_rank, df_ratio, term)``; repeated rows stay."""
    given = rows.where("text is not null and topic_key is not null").select("phrase_id", "topic_key", "phrase_rank", "df_ratio", "text")
    keyed = with_consistent_form(given, "text")
    return keyed.select("phrase_id", F.col("topic_key").alias("record"), "phrase_rank", "df_ratio", phrase_key(F.col("consistent")).alias("term"))


def top_phrases(phrases: DataFrame, topics: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` highest scored phrases of each topic as ``(topic_key, phrase_id, score, rank)``, ties to the smaller id.

    Keys are compared by 64-bit hashes, so all that is shuffled has fixed width. Rows of one phrase_id count once; should
    they differ, the least topic, key hash and df_ratio stand. The texts are read and brought into consistent form once:
    the keyed rows are written, and both the counts of keys and the scores read them from there.
    """
    total = topics.select("topic_key").distinct().count()
    hashed = phrase_rows(phrases).select("phrase_id", "record", "df_ratio", F.xxhash64("term").alias("term"))
    once = cut_lineage(hashed.groupBy("phrase_id").agg(F.min("record").alias("record"), F.min("df_ratio").alias("df_ratio"), F.min("term").alias("term")))
    inside = F.when(F.col("df_ratio").between(0.0, 1.0), F.col("df_ratio"))  # NaN sorts above 1 and is outside
    scored = distinctiveness(once, total, inside).where("score is not null")
    w = Window.partitionBy("record").orderBy(F.desc("score"), "phrase_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("record").alias("topic_key"), "phrase_id", "score", "rank")
