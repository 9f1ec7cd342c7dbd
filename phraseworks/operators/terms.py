"""Term statistics of 1-3-grams: counts per document without a shuffle, then one shuffle by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseworks.functions import text as t
from phraseworks.operators.matching import ngrams

#: Tokens of a document that count for term statistics; term mining and vectors read whole texts.
MAX_TOKENS = 120_000
N_MAX = 3


def grams(tokens: Column, n_max: int = N_MAX) -> Column:
    """All 1- to n-grams in that order; their index is the order in which a document shows them first."""
    return F.concat(*[ngrams(tokens, n) for n in range(1, n_max + 1)])


def doc_tokens(docs: DataFrame, tokens: Column | None = None, cap: int | None = None) -> DataFrame:
    """``(doc_id, tokens)``, the first ``cap`` if given; a generator binds the tokens, so later expressions do not tokenise again."""
    found = t.tokenize(F.col("text")) if tokens is None else tokens
    return docs.select("doc_id", F.explode(F.array(found if cap is None else F.slice(found, 1, cap))).alias("tokens"))


def _counted(items: Column) -> Column:
    """``array<struct<term, tf>>`` of an array: sorted once, then runs of equal items."""

    def runs(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return F.transform(
            F.array(firsts),
            lambda f: F.zip_with(f, F.concat(F.slice(f, 2, F.size(f)), F.array(F.size(s) + 1)), lambda a, b: F.struct(F.element_at(s, a).alias("term"), (b - a).cast("bigint").alias("tf"))),
        )[0]

    return F.transform(F.array(F.array_sort(items)), runs)[0]


def doc_term_counts(docs: DataFrame, n_max: int = N_MAX, tokens: Column | None = None, cap: int | None = None) -> DataFrame:
    """``(doc_id, term, tf)``, one row per document and distinct term, made inside the document's row."""
    tokenised = doc_tokens(docs, tokens, cap).where(F.size("tokens") > 0)
    return tokenised.select("doc_id", F.inline(_counted(grams(F.col("tokens"), n_max))))


def term_stats(counts: DataFrame, n_docs: int) -> DataFrame:
    """``(term, tf, df, df_ratio, first_doc)`` of ``(doc_id, term, tf)``."""
    summed = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.min("doc_id").alias("first_doc"))
    return summed.select("term", "tf", "df", (F.col("df") / F.lit(max(1, n_docs))).alias("df_ratio"), "first_doc")


def readable(docs: DataFrame) -> DataFrame:
    """Blank-normalised documents that have text."""
    return docs.withColumn("text", t.normalize_ws(F.col("text"))).where(F.length("text") > 0)


def top_terms(stats: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of highest df, then tf, ties in the order in which the corpus shows them first.

    The order of first sight is only worked out for terms that reach the k-th place, from the document that shows them first.
    """
    last = stats.orderBy(F.desc("df"), F.desc("tf")).limit(k).agg(F.min(F.struct("df", "tf")).alias("last")).first()["last"]
    if last is None:
        return stats.select("*", F.lit(0).alias("rank")).where("false")
    reach = stats.where((F.col("df") > last["df"]) | ((F.col("df") == last["df"]) & (F.col("tf") >= last["tf"])))
    first = doc_tokens(docs, cap=MAX_TOKENS).withColumnRenamed("doc_id", "first_doc").join(reach, "first_doc")
    placed = first.select("first_doc", "term", "tf", "df", "df_ratio", F.array_position(grams(F.col("tokens")), F.col("term")).alias("at"))
    best = placed.orderBy(F.desc("df"), F.desc("tf"), "first_doc", "at").limit(k)
    ranked = best.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("a"), (-F.col("tf")).alias("b"), "first_doc", "at", "term", "tf", "df", "df_ratio"))).alias("r"))  # k rows
    return ranked.select(F.posexplode("r").alias("i", "x")).select("x.term", "x.tf", "x.df", "x.df_ratio", (F.col("i") + 1).alias("rank"))


def corpus_summary(docs: DataFrame, reach: int = 200_000, shown: int = 2500) -> DataFrame:
    """One row ``summary``: the beginning of the joined corpus, documents in order as far as ``reach`` characters, blanks collapsed.

    Only as many first documents as the characters need are gathered; each adds its line break.
    """
    sized = docs.where("text is not null").select("doc_id", F.substring("text", 1, reach).alias("x"))
    k = 256
    while True:
        first = sized.orderBy("doc_id").limit(k)
        n, size = first.agg(F.count("*"), F.sum(F.length("x") + 1)).first()
        if n < k or size > reach:
            break
        k *= 2
    joined = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("doc_id", "x"))).alias("l"))
    whole = F.substring(F.array_join(F.transform("l", lambda x: x["x"]), "\n"), 1, reach)
    return joined.select(F.substring(F.regexp_replace(whole, t.BLANKS, " "), 1, shown).alias("summary"))


def in_window(stats: DataFrame, low: float, high: float) -> DataFrame:
    return stats.where(F.col("df_ratio").between(low, high))


def fallback_candidates(stats: DataFrame, low: float = 0.10, high: float = 0.85, k: int = 25) -> DataFrame:
    """General candidates where no clustering is at hand: df_ratio, then tf; ties by term."""
    fit = in_window(stats, low, high).where(F.length("term").between(2, 60))
    return fit.orderBy(F.desc("df_ratio"), F.desc("tf"), "term").limit(k)


def table_markdown(top: DataFrame) -> DataFrame:
    """One row ``md``: the table of ranked terms (as many rows as were ranked)."""
    line = F.concat_ws(" | ", "term", F.col("tf").cast("string"), F.col("df").cast("string"), F.concat(t.percent_rounded(F.col("df_ratio")).cast("string"), F.lit("%")))
    lines = top.agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select(F.concat_ws("\n", F.lit("Term | TF | DF | DF%"), F.lit("---|---:|---:|---:"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("md"))


WORDS = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_](?:[\p{L}\p{N}_/-]*[\p{L}\p{N}_])(?![\p{L}\p{N}_])"


def mined_tokens(text: Column, stopwords: list[str]) -> Column:
    """Words of at least two characters (hyphens and slashes inside), without stop-words; n-grams then bridge what was removed."""
    found = F.regexp_extract_all(F.lower(t.strip_direction_marks(text)), F.lit(WORDS), F.lit(0))
    listed = sorted({s.lower() for s in stopwords if s and len(s) >= 2})
    return F.filter(found, lambda x: ~x.isin(listed)) if listed else found


def mine_terms(docs: DataFrame, stopwords: list[str], n_docs: int, top_k: int = 200, n_max: int = 3, least: int = 3) -> DataFrame:
    """Stop-worded n-grams of highest df_ratio, then tf; ties by term."""
    counts = doc_term_counts(docs, n_max, mined_tokens(F.col("text"), stopwords))
    stats = term_stats(counts, n_docs).where(F.length("term") >= least)
    return stats.orderBy(F.desc("df_ratio"), F.desc("tf"), "term").limit(top_k).select("term", "tf", "df", "df_ratio")


