"""Every query of the core by name, and the SQL that checks it. All run over whole tables and whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phraseworks import oracles
from phraseworks.functions import text as t
from phraseworks.operators import boilerplate, cooccurrence, identifiers, kmeans, matching, selection, stopwords, terms, topics, vectors, whitelist
from phraseworks.plans import render
from phraseworks.plans.rules import Rule, parse_policy
from phraseworks.session import cut_lineage, ensure_checkpoint_dir, table
from phraseworks.streaming import matcher

#: A policy on the subjects of the corpus: invoices, agreements, inspections, personnel, access.
POLICY = """# Example policy

## Rule 1: Invoice payments
`("invoice" AND ("payment" OR "purchase order" OR "three-way match"))`

## Rule 2: Agreement terms
`(("agreement" OR "governing law") AND ("liability" OR "annex" OR "indemnifies the company"))`

## Rule 3: Site inspection
`("inspection" OR "ground resistance") OR ("ppe" AND "crew")`

## Rule 4: Personnel
`("salary details" OR "annual leave" OR "employee id") AND ("confidential" OR "human capital")`

## Rule 5: Arabic procurement
`("المورد" OR "قسم المشتريات") AND ("العقد" OR "الفاتورة" OR "سرية")`

## Rule 6: Access
`("read access" OR "credential") AND "data governance"`
"""
PHRASES = ("governing law", "salary details", "ground resistance", "internal use only", "legal affairs", "human capital", "قسم المالية", "cost center", "confidentiality notice", "data governance", "site engineering", "accounts payable")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The corpus, readable or not: ``(doc_id, text, lang, source)``."""
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return terms.readable(documents(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Languages as topic labels: ar 0, en 1, mixed 2; other or null 3."""
    number = F.when(F.col("lang") == "ar", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "mixed", 2).otherwise(3)
    return corpus(spark, d).select("doc_id", number.alias("label"))


def phrase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "idx int, phrase string")


def _n(df: DataFrame) -> int:
    return df.count()


# Texts


def normalize_ws_docs(spark, d):
    return documents(spark, d).select("doc_id", t.normalize_ws(F.col("text")).alias("text"))


def readable_docs(spark, d):
    """Every document with whether anything is left of it."""
    return documents(spark, d).select("doc_id", (F.length(t.normalize_ws(F.col("text"))) > 0).alias("readable"))


def clean_text_docs(spark, d):
    return documents(spark, d).select("doc_id", F.substring(t.clean_text(F.col("text")), 1, 2_000_000).alias("text"))


def doc_tokens_count(spark, d):
    k = documents(spark, d).select("doc_id", F.explode(F.array(t.tokenize(F.col("text")))).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n"), F.size(F.array_distinct("k")).cast("bigint").alias("n_distinct"))


def match_tokens_count(spark, d):
    k = documents(spark, d).select("doc_id", F.explode(F.array(t.tokenize_for_match(F.col("text")))).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


def identifier_token_stats(spark, d):
    k = documents(spark, d).select(F.explode(t.identifier_tokens(F.col("text"))).alias("token"))
    return k.groupBy("token").agg(F.count("*").alias("n"))


def topic_titles(spark, d):
    """The latest name of every topic preview, made safe for a title."""
    names = table(spark, d, "topic_previews").groupBy("topic_key").agg(F.max_by("name", F.struct("loaded_at", "name")).alias("name"))
    return names.select("topic_key", t.topic_title(F.col("name")).alias("title"), t.quote_phrase(F.col("name")).alias("quoted"), t.md_escape(t.blank_free(F.col("name"))).alias("escaped"))


def letter_garbage_docs(spark, d):
    return documents(spark, d).select("doc_id", t.is_letter_garbage(F.col("text")).alias("garbage"))


def quoted_phrases_docs(spark, d):
    straight = F.translate(t.blank_free(F.col("text")), "“”", '""')
    return documents(spark, d).select("doc_id", F.posexplode(t.quoted_phrases(straight)).alias("pos", "phrase"))


def corpus_summary(spark, d):
    """The beginning of the joined corpus."""
    return terms.corpus_summary(documents(spark, d))


# Statistics


def doc_ngrams_123(spark, d):
    """How many 1-, 2- and 3-grams every document has, and how many distinct ones."""
    counts = terms.doc_term_counts(documents(spark, d), cap=terms.MAX_TOKENS)
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_distinct"), F.max("tf").alias("max_tf"))


def _stats(spark, d) -> DataFrame:
    docs = corpus(spark, d)
    return terms.term_stats(terms.doc_term_counts(docs, cap=terms.MAX_TOKENS), _n(docs))


def term_stats(spark, d):
    return _stats(spark, d).select("term", "tf", "df", "df_ratio")


def term_stats_window(spark, d):
    return terms.in_window(_stats(spark, d), 0.10, 0.85).select("term", "tf", "df", "df_ratio")


def top_terms(spark, d):
    docs = corpus(spark, d)
    top = terms.top_terms(cut_lineage(_stats(spark, d)), docs, 60)
    return top.select("rank", "term", "tf", "df", t.percent_rounded(F.col("df_ratio")).alias("pct"), t.percent_cut(F.col("df_ratio")).alias("pct_cut"))


def top_terms_md(spark, d):
    docs = corpus(spark, d)
    return terms.table_markdown(terms.top_terms(cut_lineage(_stats(spark, d)), docs, 45))


def fallback_topic_candidates(spark, d):
    return terms.fallback_candidates(_stats(spark, d)).select("term", "tf", "df", "df_ratio")


def single_doc_topic(spark, d):
    """The topic of each source's largest document taken as a corpus of its own: its first 20 terms by tf (ties by term)."""
    docs = corpus(spark, d).where("source is not null")
    largest = docs.groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))
    counts = terms.doc_term_counts(docs.join(largest.select("doc_id"), "doc_id", "left_semi"), cap=terms.MAX_TOKENS).join(largest, "doc_id")
    found = topics.single_topic(counts.select(F.col("source").alias("label"), "term", "tf"))
    return found.select(F.col("label").alias("source"), "rank", F.col("phrase").alias("term"), "tf")


def mine_terms(spark, d):
    docs = corpus(spark, d)
    return terms.mine_terms(docs, [*stopwords.ENGLISH, *stopwords.ARABIC], _n(docs))


def low_generalization_terms(spark, d):
    stats = _stats(spark, d)
    flagged = stats.select(F.size(F.split("term", " ")).alias("n_words"), t.is_low_generalization(F.col("term")).alias("low"))
    return flagged.groupBy("n_words", "low").agg(F.count("*").alias("n"))


def heuristic_exclude(spark, d):
    return stopwords.heuristic_exclude(_stats(spark, d))


def auto_stopwords(spark, d):
    from_lines = stopwords.from_boilerplate(boilerplate.boilerplate_lines(documents(spark, d)))
    return stopwords.from_stats(_stats(spark, d)).unionAll(from_lines).distinct()


def include_exclude_review(spark, d):
    """Single words of the corpus under a reviewer's lists: the English stop-words out, the words of the example phrases in."""
    stats = _stats(spark, d).where(~F.col("term").contains(" "))
    include = spark.createDataFrame([(w,) for p in PHRASES for w in p.split()], "term string")
    exclude = spark.createDataFrame([(w,) for w in stopwords.ENGLISH], "term string")
    return stopwords.review(stats, include, exclude).where("decision is not null").select("term", "df", "decision")


# Vectors and topics


def _weights(spark, d, stats: DataFrame | None = None) -> DataFrame:
    """Weights over the counts of the term statistics, capped as their SQL is; ``stats`` where they are at hand."""
    docs = corpus(spark, d)
    counts = terms.doc_term_counts(docs, cap=terms.MAX_TOKENS)
    n = _n(docs)
    return vectors.tfidf(counts, vectors.vocabulary(terms.term_stats(counts, n) if stats is None else stats), n)


def tfidf_weights(spark, d):
    """The five heaviest terms of every document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    rounded = _weights(spark, d).withColumn("weight", F.round("weight", 6))
    return rounded.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("doc_id", "rank", "term", "weight")


def tfidf_column_sums(spark, d):
    return vectors.column_sums(_weights(spark, d)).select("term", F.round("score", 6).alias("score"))


def _centroids(spark, d) -> tuple[DataFrame, DataFrame]:
    """Mean weights of the languages taken as topics, and the statistics they come from, worked out once."""
    stats = cut_lineage(_stats(spark, d))
    return topics.centroid_weights(_weights(spark, d, stats), labels(spark, d)).withColumn("weight", F.round("weight", 9)), stats


def topic_tfidf_sums(spark, d):
    """Candidates of the languages taken as topics, by their mean weight."""
    return topics.candidates(*_centroids(spark, d)).select("label", "rank", "phrase", "df_ratio")


def aux_topic_phrases(spark, d):
    return topics.aux_topic_phrases(*_centroids(spark, d), 0.05, 0.85).select("label", "rank", "phrase", "df_ratio")


def tfidf_stopworded(spark, d):
    """The five heaviest terms of every document without stop-words, over all terms."""
    docs = corpus(spark, d)
    n = _n(docs)
    counts = cut_lineage(terms.doc_term_counts(docs, tokens=terms.mined_tokens(F.col("text"), [*stopwords.ENGLISH, *stopwords.ARABIC])))
    weights = vectors.tfidf(counts, terms.term_stats(counts, n).select("term", "df"), n).withColumn("weight", F.round("weight", 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("doc_id", "rank", "term", "weight")


def inferred_topics(spark, d):
    """The auxiliary inference over the whole corpus as one topic: phrases by their summed weight."""
    found = topics.infer_topics(corpus(spark, d), [*stopwords.ENGLISH, *stopwords.ARABIC], low=0.05, labels=corpus(spark, d).select("doc_id", F.lit(0).alias("label")))
    return found.phrases.select("label", "rank", "phrase", "df_ratio")


def inferred_topics_kmeans(spark, d):
    """The auxiliary inference as a whole: topics by k-means over all terms, each with its phrases."""
    return topics.infer_topics(corpus(spark, d), [*stopwords.ENGLISH, *stopwords.ARABIC], low=0.05).phrases.select("label", "rank", "phrase", "df_ratio")


def topic_sizes(spark, d):
    docs = corpus(spark, d).where("source is not null").select("doc_id", F.col("source").alias("label"))
    return topics.topic_sizes(docs, 20).select("label", "n", "first_doc", "rank")


def topic_members(spark, d):
    """Documents of every topic, in order, as the analysis stores them."""
    made = topics.ordered_members(table(spark, d, "topics_local"))
    return made.select("topic_key", "n", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


def kmeans_topics(spark, d):
    docs = corpus(spark, d)
    n = _n(docs)
    points, idf = vectors.document_counts(docs, vectors.vocabulary(terms.term_stats(terms.doc_term_counts(docs), n)), n)
    found = kmeans.kmeans_labels(points, idf, vectors.topic_count(n, 8))
    return topics.named(topics.topic_sizes(found, 8)).select("topic_name", "n", "rank")


# Co-occurrence


def _phrases_by_label(spark) -> DataFrame:
    return spark.createDataFrame([(label, i, p) for label in range(4) for i, p in enumerate(PHRASES)], "label int, idx int, phrase string")


def _presence(spark, d) -> DataFrame:
    return cooccurrence.presence(corpus(spark, d), labels(spark, d), _phrases_by_label(spark))


def _sizes(spark, d) -> DataFrame:
    return labels(spark, d).groupBy("label").agg(F.count("*").alias("n"))


def cooc_presence(spark, d):
    return _presence(spark, d)


def cooc_phrase_df(spark, d):
    return cooccurrence.phrase_df(_presence(spark, d), _phrases_by_label(spark))


def cooc_pair_df(spark, d):
    return cooccurrence.pair_df(_presence(spark, d))


def cooc_lift(spark, d):
    present = cut_lineage(_presence(spark, d))
    df = cooccurrence.phrase_df(present, _phrases_by_label(spark))
    return cooccurrence.lift(df, cooccurrence.pair_df(present), _sizes(spark, d)).withColumn("lift", F.round("lift", 9))


def topic_anchors(spark, d):
    df = cooccurrence.phrase_df(_presence(spark, d), _phrases_by_label(spark))
    return cooccurrence.anchors(_phrases_by_label(spark), df, _sizes(spark, d), ["internal use only"]).select("label", "rank", "phrase", "df")


def topic_groups(spark, d):
    present = cut_lineage(_presence(spark, d))
    phrases = _phrases_by_label(spark)
    df = cut_lineage(cooccurrence.phrase_df(present, phrases))
    return cooccurrence.groups(phrases, df, cut_lineage(cooccurrence.pair_df(present)), _sizes(spark, d), ["internal use only"])


def default_groups(spark, d):
    """Groups where co-occurrence says nothing: a topic's first and second six phrases."""
    rows = table(spark, d, "phrase_rows").dropDuplicates(["phrase_id"]).where("phrase_rank <= 12")
    made = cooccurrence.default_groups(rows.select(F.col("topic_key").alias("label"), F.struct("phrase_rank", "phrase_id").alias("pos"), t.normalize_ws(F.col("text")).alias("phrase")))
    return made.select(F.col("label").alias("topic_key"), *[F.array_join(F.col("groups")[i], "|").alias(f"group{i + 1}") for i in (0, 1)])


# Phrases kept and rules shaped


def _topic_phrases(spark, d) -> DataFrame:
    return table(spark, d, "phrase_rows").dropDuplicates(["phrase_id"]).where("text is not null").select("phrase_id", "topic_key", F.lower(t.normalize_ws(F.col("text"))).alias("phrase"))


def candidate_filter(spark, d):
    """Phrases of all topics that the corpus knows and rules may use."""
    return whitelist.candidate_filter(_topic_phrases(spark, d), _stats(spark, d), 0.001, 0.85).select("phrase_id", "phrase", "df_ratio")


def whitelist_allowed(spark, d):
    return whitelist.allowed(_topic_phrases(spark, d).withColumnRenamed("phrase_id", "pos"))


def whitelist_clean(spark, d):
    """Candidates of the topics held against the whitelist of all phrases, without the runs' generic terms."""
    rows = table(spark, d, "topics_local").select("topic_key", F.posexplode("candidates").alias("pos", "c")).select("topic_key", "pos", F.col("c.phrase").alias("phrase"))
    generic = table(spark, d, "analyze_runs").select(F.explode("generic_terms").alias("phrase")).distinct()
    offered = whitelist.allowed(_topic_phrases(spark, d).withColumnRenamed("phrase_id", "pos"))
    return whitelist.enforce(rows, offered, generic).select("topic_key", "pos", "canonical")


# Rules


def test_policy_flat(spark, d):
    return matching.test_policy_flat(documents(spark, d), POLICY)


def test_policy_hits(spark, d):
    """How often each phrase caused a match of each rule."""
    nested = matching.test_policy(documents(spark, d), POLICY)
    hits = nested.select(F.inline("matched_rules")).select("rule_id", F.explode("hit_phrases").alias("phrase"))
    return hits.groupBy("rule_id", "phrase").agg(F.count("*").alias("docs"))


def test_policy_files(spark, d):
    """The result per uploaded file, unreadable ones included."""
    rows = table(spark, d, "session_docs").dropDuplicates(["doc_id"]).select("doc_id", "name", "text")
    return matching.test_policy(rows, POLICY).select("doc_id", F.coalesce("name", F.lit("unknown")).alias("name"), "readable", "matched_any", F.size("matched_rules").cast("bigint").alias("n_rules"))


def test_policy_stream(spark, d):
    """The same from a stream of document files, through a Parquet sink."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4()}"
    stream = matcher.document_stream(spark, f"{d}/documents.parquet")
    matcher.write_matches(stream, POLICY, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", F.inline("matched_rules")).select("doc_id", "rule_id", "rule_name", F.array_join("hit_phrases", "|").alias("hits"))


def policy_on_eval_items(spark, d):
    rows = table(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"), "text")
    return matching.test_policy_flat(rows, POLICY).select("doc_id", "rule_id", "hits")


def phrase_equi_match(spark, d):
    """Documents by the phrases of a table, as an equi-join on n-grams."""
    found = matching.phrases_in_documents(documents(spark, d), phrase_table(spark).select("phrase"))
    return found.groupBy("phrase").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def phrase_present_variants(spark, d):
    """The three matchers side by side: they differ where punctuation or marks stand between words."""
    rows = matching.with_match_text(documents(spark, d)).withColumn("lc", t.norm_lc(F.col("text"))).withColumn("form", t.normalize_for_match(F.col("text")))
    tested = rows.select(*[e for i, p in enumerate(PHRASES) for e in (matching.phrase_in_tokens(p, F.col("match_text")).alias(f"a{i}"), matching.phrase_present(F.col("lc"), p).alias(f"b{i}"), matching.phrase_present_ascii_arabic(F.col("form"), p).alias(f"c{i}"))])
    sums = tested.agg(*[F.count_if(F.col(c)).alias(c) for c in tested.columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"a{i}").alias("in_tokens"), F.col(f"b{i}").alias("between_words"), F.col(f"c{i}").alias("between_alphanumerics")) for i, p in enumerate(PHRASES)])))


def rule_coverage(spark, d):
    rules = parse_policy(POLICY)
    return selection.coverage(matching.rule_truths(documents(spark, d), rules), len(rules))


def rule_mask_histogram(spark, d):
    return selection.mask_histogram(matching.rule_truths(documents(spark, d), parse_policy(POLICY)))


GROUPS = [(1, [["invoice", "payment"], ["purchase order", "supplier"]]), (2, [["the", "and"], ["of"]]), (3, [["agreement", "annex", "liability"], ["governing law", "the company", "the"], ["notice"]]), (4, [["confidential", "internal"]])]


def rule_penalty(spark, d):
    return selection.penalties(spark.createDataFrame(GROUPS, "rule_id int, groups array<array<string>>"), _stats(spark, d))


#: Rules to choose from, with groups of different sizes and of common and rare phrases.
SELECTABLE = [
    (1, [["invoice", "payment", "purchase order"], ["supplier", "accounts payable", "amount"]]), (2, [["the", "and"], ["of", "for"]]), (3, [["agreement", "annex", "liability"], ["governing law", "notice", "confidential"]]),
    (4, [["inspection", "ppe", "crew"], ["at", "near", "ground resistance"]]), (5, [["confidential"], ["internal", "notice"]]), (6, [["employee", "salary", "annual leave"], ["grade", "human capital", "balance"]]), (7, [["zzz unseen"], ["never"]]),
]


def selected_policy(spark, d):
    """Rules chosen by the documents they add, less what their groups cost, in order; filled up to four."""
    rules = [Rule(f"Rule {i}", render.all_of(groups)) for i, groups in SELECTABLE]
    costs = {r["rule_id"]: r["penalty"] for r in selection.penalties(spark.createDataFrame(SELECTABLE, "rule_id int, groups array<array<string>>"), _stats(spark, d)).collect()}  # a row a rule
    histogram = {r["mask"]: r["n"] for r in selection.mask_histogram(matching.rule_truths(documents(spark, d), rules)).collect()}  # at most 128 masks
    chosen = selection.select_rules(histogram, [costs[i] for i, _ in SELECTABLE], sum(histogram.values()), 4)
    return spark.createDataFrame([(i, rules[k].name, rules[k].expression) for i, k in enumerate(chosen, 1)], "position int, name string, expression string")


def near_policy_payload(spark, d):
    """The payload made of the six phrases that most topics have as candidates, and of the runs' five commonest generic terms."""
    phrases = table(spark, d, "topics_local").select(F.explode("candidates.phrase").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    top = [r.asDict() for r in phrases.orderBy(F.desc("n"), "term").limit(6).collect()]
    generic = table(spark, d, "analyze_runs").select(F.explode("generic_terms").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(5)
    groups = [{"terms": [x["term"] for x in top[i : i + 2]], "match": match} for i, match in ((0, "OR"), (2, "AND"), (4, "OR"))]
    made = render.payload(top, [x["term"] for x in top], [r["term"] for r in generic.collect()], groups, 10, 2)
    return spark.createDataFrame([(render.as_json(made),)], "payload string")


def combined_expression(spark, d):
    """The first three and the next three candidates of every topic as the text of a rule."""
    listed = F.transform(F.slice("candidates", 1, 6), lambda c: c["phrase"])
    rows = table(spark, d, "topics_local").select("topic_key", F.explode(F.array(listed)).alias("ps"))
    return rows.select("topic_key", t.all_of([F.slice("ps", 1, 3), F.slice("ps", 4, 3)]).alias("expression"))


def regex_catalogue_hits(spark, d):
    return identifiers.pattern_counts(documents(spark, d))


def regex_suggestions(spark, d):
    """Patterns hinted at by the name and the candidates of every topic."""
    text = F.concat_ws(" ", "topic_name", F.array_join(F.transform("candidates", lambda c: c["phrase"]), " "))
    made = table(spark, d, "topics_local").select("topic_key", F.explode(identifiers.suggested(text)).alias("x"))
    return made.select("topic_key", F.col("x.name").alias("pattern"))


def boilerplate_lines(spark, d):
    return boilerplate.boilerplate_lines(documents(spark, d))


def boilerplate_counts(spark, d):
    marked = boilerplate.marked_lines(documents(spark, d))
    return marked.groupBy("norm").agg(F.count("*").alias("n"), F.count_if("boilerplate").alias("n_boilerplate"))


def cleaned_text(spark, d):
    return boilerplate.cleaned(documents(spark, d)).select("doc_id", F.length("cleaned").cast("bigint").alias("n_chars"), F.md5("cleaned").alias("digest"))


# Structures of the application


def structured_previews(spark, d):
    """Previews as the application shows them: the latest name, the document count, the first 18 phrases."""
    last = F.max_by(F.struct("name", "doc_count"), F.struct("loaded_at", "name", "doc_count"))
    names = table(spark, d, "topic_previews").groupBy("topic_key").agg(last.alias("p")).select(F.col("topic_key").alias("label"), F.col("p.name").alias("topic_name"), F.col("p.doc_count").alias("n"))
    rows = table(spark, d, "phrase_rows").dropDuplicates(["phrase_id"])
    w = Window.partitionBy("topic_key").orderBy("phrase_rank", "phrase_id")
    ranked = rows.select(F.col("topic_key").alias("label"), F.row_number().over(w).alias("rank"), F.col("text").alias("phrase"), "df_ratio")
    shown = F.when(F.size("phrases") > 0, F.array_join(F.transform("phrases", lambda x: x["text"]), "|"))
    return topics.previews(names, ranked, 18).select(F.col("label").alias("topic_key"), F.col("topic_name").alias("name"), "doc_count", shown.alias("phrases"))


def session_term_rows(spark, d):
    """Top terms of every run, latest rows only: df, then tf, then term; 60 a run."""
    clean = table(spark, d, "term_rows").where("term is not null and tf is not null and df is not null").withColumn("term", F.lower(t.normalize_ws(F.col("term"))))
    last = clean.groupBy("run_id", "term").agg(F.max(F.struct("loaded_at", "tf", "df")).alias("x")).select("run_id", "term", "x.tf", "x.df")
    w = Window.partitionBy("run_id").orderBy(F.desc("df"), F.desc("tf"), "term")
    return last.withColumn("rank", F.row_number().over(w)).where("rank <= 60").select("run_id", "rank", "term", "tf", "df")


_ALL = (
    normalize_ws_docs, readable_docs, clean_text_docs, doc_tokens_count, match_tokens_count, identifier_token_stats, topic_titles, letter_garbage_docs, quoted_phrases_docs, corpus_summary,
    doc_ngrams_123, term_stats, term_stats_window, top_terms, top_terms_md, fallback_topic_candidates, single_doc_topic, mine_terms, low_generalization_terms, heuristic_exclude, auto_stopwords,
    include_exclude_review, tfidf_weights, tfidf_column_sums, tfidf_stopworded, inferred_topics, inferred_topics_kmeans, topic_tfidf_sums, aux_topic_phrases, topic_sizes, topic_members, kmeans_topics, cooc_presence, cooc_phrase_df, cooc_pair_df, cooc_lift,
    topic_anchors, topic_groups, default_groups, candidate_filter, whitelist_allowed, whitelist_clean, test_policy_flat, test_policy_hits, test_policy_files, test_policy_stream, policy_on_eval_items, phrase_equi_match,
    phrase_present_variants, rule_coverage, rule_mask_histogram, rule_penalty, selected_policy, near_policy_payload, combined_expression, regex_catalogue_hits, regex_suggestions, boilerplate_lines,
    boilerplate_counts, cleaned_text, structured_previews, session_term_rows,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = oracles.build(POLICY, PHRASES, GROUPS, SELECTABLE)
