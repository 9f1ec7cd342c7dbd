"""Repeated lines of a document: headers, footers, templates. All counts are within one document, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseworks.functions import text as t

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
MARKERS = r"(?i)(?<![\p{L}\p{N}_])(?:document control|version|generated by|template)(?![\p{L}\p{N}_])"
MAX_LINES = 200


def lines(text: Column, least: int = 8) -> Column:
    """``array<struct<norm, pos, line>>`` of the stripped lines of at least ``least`` characters."""
    split = F.transform(F.split(t.blank_free(text), LINE_BREAK), lambda x, i: F.struct(t.strip(x).alias("line"), i.alias("pos")))
    kept = F.filter(split, lambda x: F.length(x["line"]) >= least)
    return F.transform(kept, lambda x: F.struct(t.normalize_line(x["line"]).alias("norm"), x["pos"].alias("pos"), x["line"].alias("line")))


def _with_repeats(items: Column) -> Column:
    """Each line with how often its normalised form occurs: lines are sorted by it, equal ones are runs of the array."""

    def runs(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["norm"] != F.element_at(s, F.greatest(i - 1, F.lit(1)))["norm"]))
        return F.transform(
            F.array(firsts),
            lambda f: F.flatten(
                F.zip_with(
                    f,
                    F.concat(F.slice(f, 2, F.size(f)), F.array(F.size(s) + 1)),
                    lambda a, b: F.transform(F.slice(s, a, b - a), lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["norm"].alias("norm"), (b - a).cast("bigint").alias("repeats"))),
                )
            ),
        )[0]

    return F.when(F.size(items) > 0, F.transform(F.array(F.array_sort(items)), runs)[0])


def in_row(docs: DataFrame, least: int = 8, ratio: float = 0.35) -> DataFrame:
    """``(doc_id, marked)``: per document its lines in order, ``array<struct<pos, line, norm, repeats, boilerplate>>``.

    A line is boilerplate when its normalised form is repeated often enough for the document's length, or when it names
    itself so. A generator binds each step, so none is worked out again for every use.
    """
    read = docs.select("doc_id", F.explode(F.array(lines(F.col("text"), least))).alias("items"))
    counted = read.select("doc_id", F.explode(F.array(_with_repeats(F.col("items")))).alias("counted"))
    threshold = F.greatest(F.lit(3), F.floor(F.size("counted") * F.lit(ratio) * F.lit(0.05)))
    marked = F.transform("counted", lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["norm"].alias("norm"), x["repeats"].alias("repeats"), ((x["repeats"] >= threshold) | x["line"].rlike(MARKERS)).alias("boilerplate")))
    return counted.select("doc_id", F.explode(F.array(F.array_sort(marked))).alias("marked"))


def marked_lines(docs: DataFrame, least: int = 8, ratio: float = 0.35) -> DataFrame:
    """``(doc_id, pos, line, norm, repeats, boilerplate)``, a row per line."""
    return in_row(docs, least, ratio).select("doc_id", F.inline("marked"))


def boilerplate_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, line)``, at most the first 200 of a document."""
    first = F.slice(F.filter("marked", lambda x: x["boilerplate"]), 1, MAX_LINES)
    return in_row(docs).select("doc_id", F.inline(F.transform(first, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")))))


def cleaned(docs: DataFrame) -> DataFrame:
    """``(doc_id, cleaned)``: the kept lines in order."""
    kept = F.transform(F.filter("marked", lambda x: ~x["boilerplate"]), lambda x: x["line"])
    return in_row(docs).select("doc_id", F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("cleaned"))
