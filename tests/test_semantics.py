"""Text functions against Python, whose blanks and digits are those of Unicode; fixed texts of rules and payloads."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phraseworks import session
from phraseworks.functions import text as t
from phraseworks.operators import identifiers, topics, whitelist
from phraseworks.plans import render
from phraseworks.plans import rules as r

ALPHABET = "aZé ع٣٢0129-_/.,\"'|`\n\t\r\x0b\x1c\x1f   pageof صفحة‏"


def of(spark, texts, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", f(F.col("x")).alias("y"))
    return [x["y"] for x in sorted(df.collect(), key=lambda x: x["i"])]


def line(x):
    x = re.sub(r"\s+", " ", x).strip()
    x = re.sub(r"\bpage\s*\d+\s*(of\s*\d+)?\b", "page", x, flags=re.I)
    x = re.sub(r"صفحة\s*\d+", "صفحة", x)
    return re.sub(r"\b\d{2,}\b", "0", x).lower()


def low(x):
    s = x.strip().lower()
    if not s or re.fullmatch(r"\d{4}-\d{2}-\d{2}", s) or not any(unicodedata.category(c)[0] == "L" for c in s.replace(" ", "")):
        return True
    if re.fullmatch(r"(\w+)(\s+\1)+", s):
        return True
    return bool(re.search(r"\d{3}", s)) and " " not in s or len(s) >= 18 and bool(re.search(r"\d", s)) and "-" in s


def fences(x):
    body = re.sub(r"^```[a-zA-Z0-9_-]*", "", x.strip())
    return re.sub(r"```$", "", body).strip()


PAIRS = [(t.normalize_line, line), (t.is_low_generalization, low), (t.escape_term, lambda x: x.replace('"', "").strip()), (t.strip_code_fences, fences), (t.normalize_ws, lambda x: re.sub(r"\s+", " ", x).strip())]
FIXED = ["٢٠٢٤م", "رقم٢٠٢٤", "page ٣ of ٩", "Page 3 of 12 x", "صفحة ٧", "\n```json\n{}\n```\n", "```\na\n```", " \"x\"  ", "٢٠٢٤-٠١-٠٢", "a a a", "ref ١٢ 34", "", "12 34"]


@pytest.mark.parametrize("k", range(len(PAIRS)))
def test_fixed_texts(spark, k):
    ours, python = PAIRS[k]
    assert of(spark, FIXED, ours) == [python(x) for x in FIXED]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=14), min_size=60, max_size=60))
def test_like_python(spark, texts):
    for ours, python in PAIRS:
        got = of(spark, texts, ours)
        assert got == [python(x) for x in texts], [(x, a, python(x)) for x, a in zip(texts, got, strict=True) if a != python(x)][:3]


def test_policy_texts():
    assert [(x.name, x.expression) for x in r.parse_policy('```md\nintro\n## Rule 1: One (a)\ntext `"x"` and `"y"`\n##Rule ٢ :\n Two \n("a" OR ("b"))\n## Rule 3: none\n## Rules\n```')] == [("One (a)", '"x"'), ("Two", '"a" OR ("b")')]
    assert [(x.name, x.expression) for x in r.parse_policy("## Rule 1: A (b)\n``x`\"c\"`")] == [("A (b)", "x")]
    assert r.parse_policy("## Rule x: A\n`b`") == [] and r.parse_policy("### Rule 1: A\n`b`") == []
    assert r.strip_fences("```json\n{}\n```") == "{}" == r.strip_fences(" {} ")


def test_rule_texts(spark):
    groups = [{"terms": ['a"', " "], "match": "OR"}, {"terms": ["b", "c"]}, {"terms": [" "], "match": "OR"}, {"terms": []}]
    assert render.near_expression(groups, 5) == '(("a") NEAR/5 ("b" AND "c")) OR (("a") NEAR/5 ( )) OR (("b" AND "c") NEAR/5 ( ))'
    assert render.near_expression(groups[1:2]) == '("b" OR "c")' and render.near_expression([]) == "()"
    lists = [[["a b", "c"], ["d"]], [["x"], []], [[" ", None], []], [['"q"'], ["r", "s"]]]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(lists)], "i int, a array<string>, b array<string>").select("i", t.all_of([F.col("a"), F.col("b")]).alias("y"))
    got = {x["i"]: x["y"] for x in df.collect()}
    assert got == {i: render.all_of([[p or "" for p in g] for g in gs]) for i, gs in enumerate(lists)} and got[0] == '(("a b" OR "c") AND "d")'
    texts = ["vendor invoice", "site report", "cc-100", "msa and emp", None]
    assert of(spark, texts, lambda c: F.transform(identifiers.suggested(c), lambda x: x["name"])) == [[x["name"] for x in identifiers.suggest([p or ""])] for p in texts]


def test_checkpoints_can_be_cleared(spark):
    df = session.cut_lineage(spark.range(3).toDF("id"))
    assert df.count() == 3
    session.clear_checkpoints(spark)
    assert session.cut_lineage(spark.range(4).toDF("id")).count() == 4


def test_flattened_groups():
    assert whitelist.flattened([["a ", " b"], "no group", [None, ""], ("c",)]) == ["a", "b", "c"] and whitelist.flattened(None) == []


def test_documents_by_label(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (0, 1)], "doc_id bigint, label int")
    assert [tuple(x) for x in topics.topic_docs(labels).collect()] == [(0, 2), (1, 0), (1, 1), (1, 3)]
    stored = spark.createDataFrame([(1, [3, 1]), (2, []), (3, None)], "topic_key bigint, doc_ids array<bigint>")
    assert [tuple(x) for x in topics.ordered_members(stored).collect()] == [(1, [1, 3], 2)]
