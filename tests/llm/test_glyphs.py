import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phraseworks.llm import glyphs, queries
from tests.conftest import rows

CASES = {
    "ｂａｔｃｈ １２": "batch 12", "ﬁnal oﬀer": "final offer", "ﻻ ﻣﻋ": "لا مع", "cafe\u0301": "café", "clientè\u0323le": "clientẹ\u0300le", "\u0627\u0654": "\u0623", "of\u200bfice\ufeff": "office", "soft\u00adhy\u2060phen": "softhyphen",
    "a\u00a0b\u2009c\u3000d\te": "a b c d e", "thе wаѕ іѕ": "the was is", "РО-838546 seen": "PO-838546 seen", "milestοne": "milestone", "الموقـــع": "الموقع", "فی المشترک": "في المشترك", "Τhe": "The", "Завод іѕ": "Завод is",
}
KEPT = ["“q” – • x²", "سرّية ١٢٣", "Дом Книги", "Восток Трейд с оса", "Δ β-test ν", "café naïve", "x\u0302 y", "a\nb\r\n", "Straße ß", "", " two  blanks ", "\u0301abc", "پارک"]


@pytest.mark.parametrize(("text", "want"), CASES.items())
def test_cases(text, want):
    x = glyphs.consistent_batch([text])
    assert x.rebuilt() == [want] and x.changed.all()
    again = glyphs.consistent_batch([want])
    assert again.rebuilt() == [want] and not again.changed.any()


def test_kept():
    x = glyphs.consistent_batch(KEPT)
    assert x.rebuilt() == KEPT and not x.changed.any()


def test_sources_point_into_the_text():
    text = "a\u200bﬁ\u00adｂ e\u0301"
    x = glyphs.consistent_batch(["zz", text])
    assert x.rebuilt()[1] == "afib é"
    assert x.sources()[1].tolist() == [0, 2, 2, 4, 5, 6]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), max_size=5))
def test_stable_and_independent_of_the_batch(texts):
    once = glyphs.consistent_batch(texts).rebuilt()
    assert once == [glyphs.consistent_batch([t]).rebuilt()[0] for t in texts]
    assert all(len(glyphs.consistent_batch([t]).sources()[0]) == len(o) for t, o in zip(texts, once, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.text("aeiouAEnçا وي" + "".join(map(chr, [0x300, 0x301, 0x302, 0x308, 0x323, 0x327, 0x653, 0x654, 0x655, 0x64B, 0x651])), max_size=8))
def test_recompose_is_canonical(run):
    assert glyphs.recompose(run)[0] == unicodedata.normalize("NFC", run)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aé²–ش \n" + "ｂﬁ\u200b\u00a0\u0301аοـیﻻ\u2028"), max_size=12))
def test_filter_in_the_scan_loses_no_case(text):
    import re

    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), glyphs.IN_FORM).replace(r"\z", r"\Z")
    if glyphs.consistent_batch([text]).changed[0]:
        assert not re.search(pattern, text)


def test_filter_covers_every_mapped_character(spark):
    t = glyphs.tables()
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (t["offset"][i] >= 0 or t["look"][i] > 0)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert [r["c"] for r in df.where(~glyphs.suspect(F.col("c"))).collect()] == []


def test_tables(spark):
    data = [(1, "ｂ", "x"), (1, "ｂ", "x"), (2, None, None), (3, "", None), (4, "plain " * 300_000, None), (5, "o\u200b", None)]
    df = spark.createDataFrame(data, "id bigint, text string, changed string")
    assert rows(glyphs.inconsistent_rows(df, "id", "text")) == [(1,), (5,)]
    made = glyphs.with_consistent_form(df.withColumn("__consistent", F.lit(1)), "text")
    assert "__consistent" in made.columns
    assert [(r["id"], r["consistent"], r["changed"]) for r in made.where("id <> 4").orderBy("id").collect()] == [(1, "b", True), (1, "b", True), (2, None, False), (3, "", False), (5, "o", True)]
    assert made.where("id = 4 and not changed and consistent = text").count() == 1
    assert glyphs.inconsistent_rows(df.where("false"), "id", "text").count() == 0
    keys = spark.createDataFrame([(" A  b\u000bC ",), (None,)], "x string").select(glyphs.phrase_key(F.col("x")))
    assert rows(keys) == [("a b c",), (None,)]


def test_confusables_of_all_scripts(spark):
    alikes = glyphs.confusables(spark)
    assert len(alikes) > 200 and len(dict(alikes)) == len(alikes)
    cases = {"Ӏӏ": "Ii", "аррӏе": "appie", "Ꭺpple": "Apple", "ꓐank": "Bank", "goᴏgle": "google", "ɢoogle": "google", "ⲟrder": "order", "\u1112\u1161\u11ab\u1100\u116e\u11a8": "한국", "가\u11a8": "각"}
    x = glyphs.consistent_batch([*cases], alikes)
    assert x.rebuilt() == [*cases.values()] and x.changed.all()
    kept = [*KEPT, "סוס", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "fɪʃ", "한국", "Գարեջուր", "ⲡⲣⲁⲛ"]
    x = glyphs.consistent_batch(kept, alikes)
    assert x.rebuilt() == kept and not x.changed.any()
    df = spark.createDataFrame([(1, "аррӏе"), (2, "ꓐank"), (3, "bank"), (4, None)], "id bigint, text string")
    assert rows(glyphs.inconsistent_rows(df, "id", "text")) == [(1,), (2,)]
    assert rows(glyphs.with_consistent_form(df, "text").select("id", "consistent")) == [(1, "appie"), (2, "Bank"), (3, "bank"), (4, None)]


class WithoutIcu:
    """The JVM of a session, where ICU is not on the class path."""

    def __init__(self, jvm):
        self.jvm = jvm

    def __getattr__(self, name):
        return getattr(self.jvm, name.replace("com.ibm.icu", "com.ibm.missing"))


def test_no_result_without_the_confusables_data(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "ꓐank", None), (2, "ｂ", None)], "doc_id bigint, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/session_docs.parquet")
    spark.createDataFrame([(3, 1, "Ꭺpple"), (4, 1, "plain")], "phrase_id bigint, topic_key bigint, text string").write.parquet(f"{tmp_path}/phrase_rows.parquet")
    assert rows(queries.p4_found(spark, str(tmp_path))) == [("phrase_rows", 3), ("session_docs", 1), ("session_docs", 2)]
    monkeypatch.setattr(spark, "_jvm", WithoutIcu(spark._jvm))
    for query in (queries.p4_found, queries.p4_session_docs, queries.p4_phrase_rows):
        with pytest.raises(RuntimeError, match="confusables"):
            query(spark, str(tmp_path)).collect()


def test_runs_that_become_longer():
    cases = {"q\u0344": "q\u0308\u0301", "\u0958\u0301": "\u0915\u093c\u0301", "\ufb2c\u05b0": "\u05e9\u05b0\u05bc\u05c1", "\u0344": "\u0308\u0301", "aq\u0344e\u0301q\u0344ｂ": "aq\u0308\u0301éq\u0308\u0301b"}
    x = glyphs.consistent_batch(["zz", *cases, "e\u0301"])
    assert x.rebuilt() == ["zz", *cases.values(), "é"] and x.changed.tolist() == [False, True, True, True, True, True, True]
    assert x.sources()[5].tolist() == [0, 1, 2, 2, 3, 5, 6, 6, 7]
    again = glyphs.consistent_batch([*cases.values()])
    assert again.rebuilt() == [*cases.values()] and not again.changed.any()
