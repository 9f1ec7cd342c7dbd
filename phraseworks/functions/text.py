"""Scalar text functions as Columns. Only NFKC needs Python, and only texts that NFKC can change are sent there."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The token class, and what matching folds away.
TOKEN = r"[A-Za-z0-9؀-ۿ]+"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
DIACRITICS = r"[ً-ٰٟۖ-ۭ]"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: Characters that NFKC leaves alone next to any other of them.
NFKC_SAFE = r"\x00-\x7fÀ-ÖØ-öø-ÿΑ-ΡΣ-ωЀ-҂،؛؟ء-غـ-ي٠-٭‐‒-―‘-”†-•"


def blank_free(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank_free(c), BLANKS, " "))


def norm_lc(c: Column) -> Column:
    return F.lower(normalize_ws(c))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank_free(c)), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    return F.coalesce(_nfkc(F.when(c.rlike(f"[^{NFKC_SAFE}]"), c)), c)


def fold_for_match(c: Column) -> Column:
    """Everything of ``normalize_for_match`` that comes before NFKC."""
    quoted = F.translate(F.lower(blank_free(c)), "“”’ـ", "\"\"'")
    return F.translate(F.regexp_replace(quoted, DIACRITICS, ""), "أإآ", "ااا")


def normalize_for_match(c: Column) -> Column:
    return normalize_ws(nfkc(fold_for_match(c)))


def tokenize_for_match(c: Column) -> Column:
    return F.regexp_extract_all(normalize_for_match(c), F.lit(TOKEN), F.lit(0))


def padded(tokens: Column) -> Column:
    """Tokens joined for sequence search: a phrase is in them exactly if ``' phrase '`` is in this text, since no token holds a blank."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def quote_phrase(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(normalize_ws(c), '^"+|"+$', ""), "^'+|'+$", "")
    return F.concat(F.lit('"'), bare, F.lit('"'))


def _joined(parts: Column, word: str) -> Column:
    """The parts joined by the operator, in parentheses if there are several."""
    return F.when(F.size(parts) == 1, parts[0]).when(F.size(parts) > 1, F.concat(F.lit("("), F.array_join(parts, f" {word} "), F.lit(")"))).otherwise("")


def any_of(phrases: Column) -> Column:
    """A group of phrases as rule text; blank ones are left out."""
    return _joined(F.transform(F.filter(phrases, lambda p: F.length(normalize_ws(p)) > 0), quote_phrase), "OR")


def all_of(groups: Sequence[Column]) -> Column:
    """Groups of phrases as rule text; empty ones are left out."""
    return _joined(F.filter(F.array(*[any_of(g) for g in groups]), lambda g: F.length(g) > 0), "AND")


def topic_title(c: Column) -> Column:
    kept = F.trim(F.regexp_replace(normalize_ws(c), r"[^\p{L}\p{N}_؀-ۿ\s&/-]+", ""))
    return F.when(F.length(kept) > 0, F.substring(kept, 1, 80)).otherwise("Untitled Topic")


def is_letter_garbage_tokens(tokens: Column) -> Column:
    """At least four tokens of which at least half are single characters."""
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    return (F.size(tokens) >= 4) & (single * 2 >= F.size(tokens))


def is_letter_garbage(c: Column) -> Column:
    return is_letter_garbage_tokens(tokenize_for_match(c))


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9٠-٩۰-۹]+$")


def md_escape(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def escape_term(c: Column) -> Column:
    return strip(F.replace(blank_free(c), F.lit('"'), F.lit("")))


def strip_direction_marks(c: Column) -> Column:
    return normalize_ws(F.translate(blank_free(c), "‏‎", "  "))


def identifier_tokens(c: Column) -> Column:
    """Tokens that keep dots, slashes, hyphens and underscores, lower-cased."""
    found = F.regexp_extract_all(blank_free(c), F.lit(r"[A-Za-z0-9_./-]+|[؀-ۿ0-9_./-]+"), F.lit(0))
    return F.transform(found, F.lower)


def normalize_line(c: Column) -> Column:
    """A line without what differs between repetitions: page numbers and runs of digits."""
    one = normalize_ws(c)
    paged = F.regexp_replace(one, rf"(?i)(?<!{WORD_CHAR})page\s*\p{{Nd}}+\s*(?:of\s*\p{{Nd}}+)?(?!{WORD_CHAR})", "page")
    paged = F.regexp_replace(paged, r"صفحة\s*[\p{Nd}]+", "صفحة")
    return F.lower(F.regexp_replace(paged, rf"(?<!{WORD_CHAR})\p{{Nd}}{{2,}}(?!{WORD_CHAR})", "0"))


def is_low_generalization(c: Column) -> Column:
    """Dates, numbers, identifiers and repeated words do not carry over to other documents."""
    s = F.lower(strip(blank_free(c)))
    return (
        (s == "")
        | s.rlike(r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$")
        | F.replace(s, F.lit(" "), F.lit("")).rlike(r"^[^\p{L}]+$")
        | s.rlike(rf"(?U)^({WORD_CHAR}+)(?:[\s\x1c-\x1f]+\1)+$")
        | (s.rlike(r"\p{Nd}{3}") & ~s.contains(" "))
        | ((F.length(s) >= 18) & s.rlike(r"\p{Nd}") & s.contains("-"))
    )


def clean_text(c: Column) -> Column:
    """NUL and runs of blanks to one space, at most one empty line in a row."""
    spaced = F.regexp_replace(F.translate(blank_free(c), "\x00", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def strip_code_fences(c: Column) -> Column:
    """Without a fence line at the beginning and one at the end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z0-9_-]*", ""), r"```$", ""))


def quoted_phrases(c: Column) -> Column:
    return F.regexp_extract_all(blank_free(c), F.lit('"([^"]+)"'), F.lit(1))


def percent_rounded(ratio: Column) -> Column:
    """Half to even."""
    return F.bround(ratio * 100, 0).cast("int")


def percent_cut(ratio: Column) -> Column:
    return (ratio * 100).cast("int")


# The same on the driver, for phrases and rules (small).

_BLANKS = re.compile(r"\s+")
_TOKEN = re.compile(TOKEN)
_DIACRITICS = re.compile(DIACRITICS)
_FOLD = str.maketrans({"“": '"', "”": '"', "’": "'", "ـ": None})
_ALEF = str.maketrans("أإآ", "ااا")


def ws(text: object) -> str:
    return _BLANKS.sub(" ", str(text or "")).strip()


def match_form(text: str | None) -> str:
    folded = _DIACRITICS.sub("", (text or "").lower().translate(_FOLD)).translate(_ALEF)
    return ws(unicodedata.normalize("NFKC", folded))


def match_tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(match_form(text))


def letter_garbage(text: str) -> bool:
    tokens = match_tokens(text)
    return len(tokens) >= 4 and 2 * sum(len(t) == 1 for t in tokens) >= len(tokens)


def safe_title(name: str) -> str:
    return re.sub(r"[^\w؀-ۿ\s&/-]+", "", ws(name)).strip()[:80] or "Untitled Topic"
