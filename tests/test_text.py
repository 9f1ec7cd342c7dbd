from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phraseworks.functions import text as t
from tests.conftest import rows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, "café_PO-775193", t.tokenize) == ["caf", "po", "775193"]
    assert one(spark, "عينة، اختبار", t.tokenize) == ["عينة،", "اختبار"]
    assert one(spark, None, t.tokenize) == []
    assert one(spark, "", t.tokenize) == []


def test_match_form(spark):
    cases = {"سرّيـــة": "سرية", "أحمد/إحمد/آحمد": "احمد/احمد/احمد", " “A”  b’s\x1c c ": "\"a\" b's c", "ﬁve ² Ａ": "five 2 a".replace("a", "a"), None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", t.normalize_for_match(F.col("x")).alias("y"))
    got = {r["x"]: r["y"] for r in df.collect()}
    assert got == {k: t.match_form(k) for k in cases}
    assert got["سرّيـــة"] == "سرية" and got["أحمد/إحمد/آحمد"] == "احمد/احمد/احمد" and got[None] == ""


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=40, max_size=40))
def test_match_form_equals_driver(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.fold_for_match(F.col("x")).alias("folded"), t.nfkc(F.col("x")).alias("n"))
    import unicodedata

    for r in df.collect():
        assert r["n"] == unicodedata.normalize("NFKC", texts[r["i"]])


def test_garbage_and_percent(spark):
    assert [one(spark, x, t.is_letter_garbage) for x in ("a c m e", "a c m", "word two three four", None)] == [True, False, False, False]
    assert [t.letter_garbage(x) for x in ("a c m e", "a c m")] == [True, False]
    df = spark.createDataFrame([(0.125,), (0.29,), (0.375,)], "r double").select(t.percent_rounded(F.col("r")).alias("a"), t.percent_cut(F.col("r")).alias("b"))
    assert rows(df) == [(12, 12), (29, 28), (38, 37)]


def test_lines_and_titles(spark):
    assert one(spark, " Page 3 of 12  ref 12345 ", t.normalize_line) == "page ref 0"
    assert one(spark, "صفحة 7", t.normalize_line) == "صفحة"
    assert one(spark, "  A*b (c) & d/e-f  ", t.topic_title) == "Ab c & d/e-f"
    assert one(spark, "***", t.topic_title) == "Untitled Topic" == t.safe_title("***")
    assert one(spark, ' "\'x y\'" ', t.quote_phrase) == '"x y"'
    assert one(spark, "```json\n{}\n```", t.strip_code_fences) == "{}"
    assert one(spark, 'a "b c" or "d"', t.quoted_phrases) == ["b c", "d"]
    assert one(spark, "a\x00b \t c\n\n\n\nd ", t.clean_text) == "a b c\n\nd"
    assert one(spark, "A_b-c/d. e", t.identifier_tokens) == ["a_b-c/d.", "e"]


def test_low_generalization(spark):
    cases = {"2024-01-02": True, "12 34": True, "ppm ppm": True, "ppm ppm ppm": True, "inv20245": True, "room 12345": False, "": True, "work permit": False, "reference 12-abc long": True, "ppm pp": False}
    for text, low in cases.items():
        assert one(spark, text, t.is_low_generalization) is low, text
