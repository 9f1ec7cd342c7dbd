import io
import zipfile

import pytest

from phraseworks.engine import Engine, NoReadableText, WriterRequired
from phraseworks.functions.text import match_tokens
from phraseworks.plans.rules import evaluate, parse_policy
from phraseworks.sources import files
from phraseworks.sources.store import UnknownSession
from phraseworks.streaming import matcher
from tests.conftest import rows

TEXTS = [f"purchase order and vendor invoice with payment terms and bank details number {i}" for i in range(6)] + [f"site inspection found work permit and safety barrier near crane zone {i}" for i in range(6)]


def word(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"first\xff line\n\nsecond")
    (tmp_path / "b.docx").write_bytes(word("one", "", "two"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"broken")
    assert rows(files.scan(spark, str(tmp_path)).select("doc_id", "name", "text", "readable")) == [(0, "a.txt", "first line second", True), (1, "b.docx", "one two", True), (2, "c.docx", "", False), (3, "d.pdf", "", False)]
    assert files.extract_strict("x.TXT", b"a\0 \t b\n\n\n\nc") == "a b\n\nc"
    with pytest.raises(ValueError, match="unsupported"):
        files.extract_strict("x.md", b"")


def test_analyze_generate_test(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "sessions"))
    assert engine.health() == {"ok": True}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i // 6) for i in range(12)], "doc_id bigint, label int")
    done = engine.analyze(docs, labels=labels)
    assert done.n_docs == 12 and [t["doc_count"] for t in done.topics_preview] == [6, 6]
    assert done.top_terms[0]["term"] == "and" and done.top_terms_md.startswith("Term | TF")
    policy = engine.generate_policy(done.session_id, max_rules=2)
    assert len(parse_policy(policy)) == 2
    got = engine.test_policy(policy, docs)
    assert got.where("matched_any").count() == 12
    with pytest.raises(UnknownSession):
        engine.generate_policy("missing")
    with pytest.raises(NoReadableText):
        engine.analyze(spark.createDataFrame([(1, " ")], "doc_id bigint, text string"))


def test_analyze_by_clustering(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "sessions"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    done = engine.analyze(docs, max_topics=2)
    assert sorted(t["doc_count"] for t in done.topics_preview) == [6, 6]
    one = engine.analyze(docs.limit(1))
    assert one.topics_preview[0]["name"] == "Single Document Topic" and len(one.topics_preview[0]["phrases"]) == 12


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    policy = '## Rule 1: Payments\n`"vendor invoice" AND "bank details"`'
    query = matcher.write_matches(matcher.document_stream(spark, str(tmp_path / "in"), files_per_trigger=1), policy, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("matched_any").count() == 6 and got.count() == 12


CORPUS = {
    "inv1.txt": "Invoice from vendor. Bank details and payment terms follow.", "inv2.txt": "Vendor invoice: payment terms, bank details, due date.", "inv3.txt": "The vendor sent bank details with payment terms.", "inv4.txt": "payment terms; bank details; vendor",
    "saf1.txt": "Work permit and safety barrier at the crane.", "saf2.txt": "Crane moved. Safety barrier set, work permit shown.", "saf3.txt": "safety barrier, work permit, crane", "saf4.txt": "No crane without work permit and safety barrier!", "empty.txt": " \n ",
}


def test_golden_analyze_generate_test(spark, tmp_path):
    """The whole flow on files, worked out by hand: statistics, topics, preview, policy and result."""
    (tmp_path / "in").mkdir()
    for name, text in CORPUS.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    docs = files.scan(spark, str(tmp_path / "in"))
    engine = Engine(spark, str(tmp_path / "sessions"))
    labels = docs.where("readable").selectExpr("doc_id", "if(name like 'inv%', 0, 1) as label")
    done = engine.analyze(docs, labels=labels, corpus_hint="finance")
    assert done.n_docs == 8 and done.generic_terms == []
    assert {x["term"]: (x["tf"], x["df"], x["df_ratio"]) for x in done.top_terms}["and"] == (3, 3, 0.375)
    assert done.top_terms_md.split("\n")[:2] == ["Term | TF | DF | DF%", "---|---:|---:|---:"] and done.top_terms_md.split("\n")[2].endswith(" | 4 | 4 | 50%")
    assert done.topics_preview_md.startswith("Topics (preview)\nHigh-signal phrases per topic (DF% hints generalization).\n\n### Topic 1\n4 docs\n- ")
    assert {x["name"]: x["doc_count"] for x in done.topics_preview} == {"Topic 1": 4, "Topic 2": 4}
    first = {p["text"] for p in done.topics_preview[0]["phrases"]}
    assert {"bank details", "payment terms", "vendor"} <= first and all(p["df_ratio"] >= 0.10 for p in done.topics_preview[0]["phrases"])
    stored = engine.store.get(done.session_id, "docs")
    assert rows(stored.select("name", "n_bytes")) == sorted((n, len(x.encode())) for n, x in CORPUS.items() if x.strip())
    policy = engine.generate_policy(done.session_id, title="Golden", max_rules=2)
    lines = policy.split("\n")
    assert lines[:7] == ["# Golden", "", "Format: Symantec-style boolean rules (AND groups of OR phrases). No proximity logic.", "", "## Rules", "", "## Rule 1: Topic 1"]
    assert lines[7].startswith("`((") and lines[8:12] == ["", "**Why chosen:**", "- Built from co-occurrence and whitelisted topic phrases to balance recall and precision.", ""] and lines[12] == "---"
    got = engine.test_policy(policy, docs)
    rules = parse_policy(policy)
    want = {n: [x.name for x in rules if evaluate(x.tree, match_tokens(text))[0]] for n, text in CORPUS.items()}
    assert {r["name"]: [m["rule_name"] for m in r["matched_rules"]] for r in got.collect()} == want
    assert all(want[n] in ([], ["Topic 1" if n.startswith("inv") else "Topic 2"]) for n in CORPUS) and sum(map(bool, want.values())) >= 6 and not want["empty.txt"]
    with pytest.raises(WriterRequired):
        engine.analyze(docs, writer_required=True)
    with pytest.raises(WriterRequired):
        engine.generate_policy(done.session_id, writer_required=True)
