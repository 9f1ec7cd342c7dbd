"""Identifier patterns of business documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and patterns.
CATALOGUE = (
    ("Invoice number", r"\bINV-\d{4}-\d{4,6}\b"),
    ("PO number", r"\bPO-\d{5,8}\b"),
    ("Work Permit", r"\bWP-[A-Z0-9]{2,10}-\d{4}-\d{4,6}\b"),
    ("MSA agreement id", r"\bMSA-[A-Z0-9]{2,10}-\d{4}-\d{2}\b"),
    ("Cost center", r"\bCC-\d{3,6}\b"),
    ("Project code", r"\bPRJ-[A-Z0-9]{2,20}-[A-Z0-9]{2,20}-\d{2}\b"),
    ("Employee ID", r"\bEMP-\d{5,8}\b"),
    ("Vendor ID", r"\bVND-[A-Z0-9]{2,20}-\d{3,6}\b"),
    ("IBAN (SA)", r"\bSA\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b"),
)
# Words that hint at a pattern (by a word of its name); the first pattern family hinted at decides.
HINTS = (("invoice", ("invoice", "inv")), ("po", ("po", "purchase")), ("msa", ("msa",)), ("cost center", ("cc-",)), ("project", ("prj",)), ("employee", ("emp",)), ("vendor", ("vnd",)), ("iban", ("iban",)))


def pattern_counts(docs: DataFrame) -> DataFrame:
    """``(name, docs, hits)`` over all documents in one pass."""
    counted = docs.select(*[F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).alias(f"p{i}") for i, (_, p) in enumerate(CATALOGUE)])
    zero = F.lit(0).cast("bigint")
    sums = counted.agg(*[e for i in range(len(CATALOGUE)) for e in (F.coalesce(F.sum(f"p{i}"), zero).alias(f"h{i}"), F.count_if(F.col(f"p{i}") > 0).alias(f"d{i}"))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"d{i}").alias("docs"), F.col(f"h{i}").alias("hits")) for i, (n, _) in enumerate(CATALOGUE)])))


def suggest(phrases: Sequence[str]) -> list[dict[str, str]]:
    """Patterns the phrases hint at, by plain substrings; without any hint the first four."""
    text = " ".join(phrases).lower()
    hinted = {family for family, words in HINTS if any(w in text for w in words)}
    kept = [{"name": n, "regex": p} for n, p in CATALOGUE if any(f in hinted and f in n.lower() for f, _ in HINTS)]
    return kept or [{"name": n, "regex": p} for n, p in CATALOGUE[:4]]


def suggested(text: Column) -> Column:
    """``array<struct<name, regex>>``: the same for a text per row, the phrases of a topic joined."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hinted = {family: reduce(or_, [F.contains(low, F.lit(w)) for w in words]) for family, words in HINTS}
    entries = [(F.struct(F.lit(n).alias("name"), F.lit(p).alias("regex")), [hinted[f] for f, _ in HINTS if f in n.lower()]) for n, p in CATALOGUE]
    kept = F.array_compact(F.array(*[F.when(reduce(or_, when), entry) for entry, when in entries if when]))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*[entry for entry, _ in entries[:4]]))
