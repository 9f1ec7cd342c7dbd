"""Matching rules and phrases against documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseworks.functions import text as t
from phraseworks.plans import rules as r

MAX_HITS = 12
#: Phrases that may stand in a plan as literals.
MAX_LISTED = 1000


def with_match_text(docs: DataFrame, text: str = "text", into: str = "match_text") -> DataFrame:
    """Adds the padded tokens; every predicate on a document reads this one column.

    A generator binds it: projections that use it many times would otherwise be merged with it and work it out each time.
    """
    return docs.select(*[c for c in docs.columns if c != into], F.explode(F.array(t.padded(t.tokenize_for_match(t.normalize_ws(F.col(text)))))).alias(into))


def phrase_in_tokens(phrase: str, match_text: Column) -> Column:
    """The phrase's tokens are a contiguous run of the document's tokens."""
    sequence = " ".join(t.match_tokens(t.match_form(phrase)))
    return F.contains(match_text, F.lit(f" {sequence} ")) if sequence else F.lit(False)


def _literal_between(phrase: str | Column, side: str) -> Column:
    column = F.lit(phrase) if isinstance(phrase, str) else phrase
    quoted = F.concat(F.lit(r"\Q"), F.replace(column, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(f"(?<!{side})"), quoted, F.lit(f"(?!{side})"))


def phrase_present(text_lc: Column, phrase: str | Column) -> Column:
    """Literal occurrence between word boundaries in lower-cased, blank-normalised text; punctuation between words blocks it."""
    needle = phrase if isinstance(phrase, Column) else F.lit(t.ws(phrase).lower())
    return (F.length(needle) > 0) & F.regexp_like(text_lc, _literal_between(needle, t.WORD_CHAR))


def phrase_present_ascii_arabic(match_form: Column, phrase: str) -> Column:
    """The same with boundaries of ASCII alphanumerics and Arabic only, on text in match form."""
    needle = t.match_form(phrase)
    return F.regexp_like(match_form, _literal_between(needle, r"[A-Za-z0-9؀-ۿ]")) if needle else F.lit(False)


def distinct_sequences(rules: Sequence[r.Rule]) -> list[str]:
    return sorted({p.sequence for rule in rules for p in r.phrases(rule.tree) if p.sequence})


def with_presence(docs: DataFrame, rules: Sequence[r.Rule], into: str = "present") -> tuple[DataFrame, dict[str, Column]]:
    """Every distinct phrase of all rules tested once per document, as an array of flags; and the flag of each phrase."""
    sequences = distinct_sequences(rules)
    flags = F.array(*[F.contains("match_text", F.lit(f" {s} ")) for s in sequences]) if sequences else F.array().cast("array<boolean>")
    return with_match_text(docs).select("*", F.explode(F.array(flags)).alias(into)), {s: F.col(into)[i] for i, s in enumerate(sequences)}


def test_policy(docs: DataFrame, policy_text: str) -> DataFrame:
    """``docs (doc_id, text, ...)`` with ``readable``, ``matched_any`` and ``matched_rules``: one projection, no shuffle."""
    rules = r.parse_policy(policy_text)
    if not rules:
        raise ValueError("no rules found: expected '## Rule n: name' with an expression, or '**name**: `expression`'")
    tested, present = with_presence(docs, rules)
    results = [F.when(r.truth(x.tree, present), F.struct(F.lit(i).alias("rule_id"), F.lit(x.name).alias("rule_name"), F.slice(r.hits(x.tree, present), 1, MAX_HITS).alias("hit_phrases"))) for i, x in enumerate(rules, 1)]
    readable = F.col("match_text").isNotNull() & (F.length(t.normalize_ws(F.col("text"))) > 0)
    none = F.array().cast("array<struct<rule_id:int,rule_name:string,hit_phrases:array<string>>>")
    made = tested.withColumn("readable", readable).withColumn("matched_rules", F.when(F.col("readable"), F.array_compact(F.array(*results))).otherwise(none))
    return made.withColumn("matched_any", F.size("matched_rules") > 0).drop("match_text", "present")


def test_policy_flat(docs: DataFrame, policy_text: str) -> DataFrame:
    """``(doc_id, rule_id, rule_name, hits)`` of every match, hits joined by ``|``."""
    nested = test_policy(docs.select("doc_id", "text"), policy_text)
    return nested.select("doc_id", F.inline("matched_rules")).select("doc_id", "rule_id", "rule_name", F.array_join("hit_phrases", "|").alias("hits"))


def rule_truths(docs: DataFrame, rules: Sequence[r.Rule]) -> DataFrame:
    """``(doc_id, mask)``: bit i is set where rule i (from 0) matches; at most 62 rules."""
    if len(rules) > 62:
        raise ValueError("a mask holds at most 62 rules")
    tested, present = with_presence(docs.select("doc_id", "text"), rules)
    bits = [F.when(r.truth(x.tree, present), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, x in enumerate(rules)]
    return tested.select("doc_id", sum(bits[1:], bits[0]).alias("mask") if bits else F.lit(0).cast("bigint").alias("mask"))


def phrases_in_documents(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(doc_id, phrase)`` for a table of phrases (distinct token sequences in ``phrase``): an equi-join, not a cross product.

    Documents emit the n-grams whose length some phrase has; the phrase table is joined on the n-gram. Spark broadcasts it
    if its size allows and shuffles it otherwise. Up to ``MAX_LISTED`` phrases, counted first, are also a set of literals,
    so other n-grams go inside the row, before a row is made of each.
    """
    keyed = phrases.select("phrase", t.tokenize_for_match(F.col("phrase")).alias("k")).where(F.size("k") > 0).select("phrase", F.array_join("k", " ").alias("gram"), F.size("k").alias("n"))
    lengths = sorted(x["n"] for x in keyed.select("n").distinct().collect())  # a few numbers
    if not lengths:
        return docs.select("doc_id").where("false").select("doc_id", F.lit("").alias("phrase"))
    tokens = docs.select("doc_id", F.explode(F.array(t.tokenize_for_match(t.normalize_ws(F.col("text"))))).alias("k"))
    every = F.concat(*[ngrams(F.col("k"), n) for n in lengths])
    listed = [r["gram"] for r in keyed.select("gram").distinct().limit(MAX_LISTED + 1).collect()]
    if len(listed) <= MAX_LISTED:
        every = F.filter(every, lambda g: g.isin(listed))
    grams = tokens.select("doc_id", F.explode(F.array_distinct(every)).alias("gram"))
    return grams.join(keyed, "gram").select("doc_id", "phrase").distinct()


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by blanks; empty if there are fewer."""
    if n <= 1:
        return tokens
    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(none)
