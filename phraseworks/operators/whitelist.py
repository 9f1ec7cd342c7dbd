"""Keeping rules to phrases that were offered, and rules in shape. Tables for bulk use, plain functions for a policy's few rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseworks.functions import text as t

MIN_KEY = 3
MAX_GROUP, MIN_GROUP, MAX_GROUPS, MIN_GROUPS = 8, 2, 4, 2


def _too_small(key: Column, tokens: Column) -> Column:
    return (F.length(key) < MIN_KEY) | ((F.size(tokens) == 1) & (F.length(tokens[0]) < MIN_KEY))


def keyed(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Adds ``key`` (match form) and ``tokens``; the generator binds both."""
    clean = t.normalize_ws(F.col(phrase))
    form = phrases.select("*", F.explode(F.array(t.normalize_for_match(clean))).alias("key"))
    return form.select("*", F.explode(F.array(F.regexp_extract_all("key", F.lit(t.TOKEN), F.lit(0)))).alias("tokens"))


def candidate_filter(phrases: DataFrame, stats: DataFrame, low: float, high: float) -> DataFrame:
    """Phrases fit for rules: known to the statistics, in the window, not letters in a row, not tiny, not a number."""
    rows = keyed(phrases).join(stats.select(F.col("term").alias("phrase"), "df_ratio"), "phrase")
    fit = ~t.is_letter_garbage_tokens(F.col("tokens")) & ~_too_small(F.col("key"), F.col("tokens")) & F.col("df_ratio").between(low, high) & ~t.is_digits(F.col("phrase"))
    return rows.where(fit).drop("key", "tokens")


def allowed(phrases: DataFrame) -> DataFrame:
    """``(key, canonical)``: per key the first of ``(pos, phrase)`` in its own spelling."""
    rows = keyed(phrases).where((F.length(t.normalize_ws(F.col("phrase"))) > 0) & ~t.is_letter_garbage_tokens(F.col("tokens")) & (F.length("key") >= MIN_KEY))
    return rows.groupBy("key").agg(F.min_by(t.normalize_ws(F.col("phrase")), "pos").alias("canonical"))


def enforce(phrases: DataFrame, allowed_phrases: DataFrame, generic: DataFrame) -> DataFrame:
    """``phrases`` that are allowed and not generic, with ``canonical``; generic ``(phrase)``."""
    rows = keyed(phrases).where(~t.is_letter_garbage_tokens(F.col("tokens")) & ~_too_small(F.col("key"), F.col("tokens")))
    canon = rows.drop("tokens").join(allowed_phrases, "key").drop("key").withColumn("key", t.normalize_for_match(F.col("canonical")))
    banned = generic.where(F.length(t.normalize_ws(F.col("phrase"))) > 0).select(t.normalize_for_match(F.col("phrase")).alias("key")).distinct()
    return canon.join(banned, "key", "left_anti").drop("key")


# On the driver, for the rules of one policy.


def flattened(groups: object) -> list[str]:
    """The phrases of groups in order, blank ones and whatever is no group left out."""
    kept = [g for g in groups if isinstance(g, (list, tuple))] if isinstance(groups, (list, tuple)) else []
    return [p for p in (t.ws(x) for g in kept for x in g) if p]


def allowed_map(phrases: Iterable[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for p in map(t.ws, phrases):
        key = t.match_form(p)
        if p and len(key) >= MIN_KEY and not t.letter_garbage(p):
            found.setdefault(key, p)
    return found


def canonical(phrase: object, offered: Mapping[str, str], generic: Iterable[str]) -> str | None:
    p = t.ws(phrase)
    key, tokens = t.match_form(p), t.match_tokens(p)
    if len(key) < MIN_KEY or (len(tokens) == 1 and len(tokens[0]) < MIN_KEY) or t.letter_garbage(p):
        return None
    own = offered.get(key)
    return own if own and t.match_form(own) not in {t.match_form(g) for g in generic if t.ws(g)} else None


def shaped(groups: Sequence[object]) -> list[list[str]]:
    """Groups without repeated phrases, of 2 to 8 phrases, 2 to 4 of them; else none."""
    fit = []
    for group in groups:
        if isinstance(group, (list, tuple)):
            once = {t.match_form(p): p for p in reversed(group)}
            own = [p for p in dict.fromkeys(group) if once.get(t.match_form(p)) == p][:MAX_GROUP]
            if len(own) >= MIN_GROUP:
                fit.append(own)
    return fit[:MAX_GROUPS] if len(fit) >= MIN_GROUPS else []


def clean_groups(groups: object, fallback: Sequence[Sequence[str]], offered: Mapping[str, str], generic: Iterable[str]) -> list[list[str]]:
    """A rule's groups with offered phrases only; if nothing in shape is left, the fallback groups (whose own spelling may stand)."""
    listed = [g for g in groups if isinstance(g, (list, tuple))] if isinstance(groups, (list, tuple)) else []
    strict = [[c for c in (canonical(x, offered, generic) for x in g) if c] for g in listed]
    loose = [[c for c in (canonical(x, offered, generic) or t.ws(x) for x in g) if c and not t.letter_garbage(c)] for g in fallback]
    return shaped([g for g in strict if g]) or shaped([g for g in loose if g])
