import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phraseworks.functions.text import match_tokens
from phraseworks.operators import matching
from phraseworks.plans import render
from phraseworks.plans import rules as r
from tests.conftest import rows

TEXT = "Vendor: ACME Supplies. PPE report"
TRUTH = [
    ('"vendor acme"', True, {"vendor acme"}), ('"acme vendor"', False, set()), ('"po"', False, set()), ('"ppe" OR "acme" AND "zzz"', True, {"ppe"}),
    ('("ppe" OR "acme") AND "zzz"', False, set()), ('("ppe" OR "acme") AND "report"', True, {"ppe", "acme", "report"}), ('"ppe" AND', False, set()), ('"zzz" "ppe"', True, {"ppe"}),
    ('"ppe" "zzz"', False, set()), ('("zzz") NEAR/10 ("ppe")', True, {"ppe"}), ('"***"', False, set()), ("", False, set()), ('"ppe") AND ("report"', True, {"ppe", "report"}),
]


@pytest.mark.parametrize(("expression", "truth", "hits"), TRUTH)
def test_truth_table_on_driver(expression, truth, hits):
    assert r.evaluate(r.parse_expression(expression), match_tokens(TEXT)) == (truth, frozenset(hits))


def test_truth_table_as_columns(spark):
    rules = [r.Rule(str(i), e) for i, (e, _, _) in enumerate(TRUTH)]
    tested, present = matching.with_presence(spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string"), rules)
    got = tested.select(*[F.struct(r.truth(x.tree, present).alias("t"), r.hits(x.tree, present).alias("h")).alias(x.name) for x in rules]).first()
    for x, (_, truth, hits) in zip(rules, TRUTH, strict=True):
        assert (got[x.name]["t"], set(got[x.name]["h"])) == (truth, hits), x


WORDS = ["ppe", "acme", "vendor acme", "zzz", "report", "x y"]
PIECES = st.lists(st.sampled_from([*(f'"{w}"' for w in WORDS), "AND", "OR", "(", ")", "near"]), max_size=12)


@settings(max_examples=15, deadline=None)
@given(st.lists(PIECES, min_size=8, max_size=8), st.lists(st.sampled_from("ppe acme vendor report x y".split()), max_size=8))
def test_columns_equal_driver(spark, expressions, words):
    rules = [r.Rule(str(i), " ".join(p)) for i, p in enumerate(expressions)]
    tested, present = matching.with_presence(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), rules)
    got = tested.select(*[F.struct(r.truth(x.tree, present).alias("t"), r.hits(x.tree, present).alias("h")).alias(x.name) for x in rules]).first()
    for x in rules:
        truth, hits = r.evaluate(x.tree, match_tokens(" ".join(words)))
        assert (got[x.name]["t"], set(got[x.name]["h"])) == (truth, set(hits)), x


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=4), min_size=1, max_size=3), st.lists(st.sampled_from("ppe acme vendor report x y".split()), max_size=8))
def test_rendered_rules_read_back(groups, words):
    policy = render.policy_markdown("T", [{"title": "Rule a", "expr": render.all_of(groups)}])
    (rule,) = r.parse_policy(policy)
    text = f" {' '.join(words)} "
    assert r.evaluate(rule.tree, words)[0] == all(any(f" {p} " in text for p in g) for g in groups)


def test_policy_forms():
    a = "```markdown\n# T\n\n## Rule 1: First\n`(\"a\")`\n\n## Rule 2: Second\ntext (\"b\" AND \"c\")\n```"
    assert [(x.name, x.expression) for x in r.parse_policy(a)] == [("First", '("a")'), ("Second", '"b" AND "c"')]
    assert [(x.name, x.expression) for x in r.parse_policy('**N**: `"a" OR "b"`')] == [("N", '"a" OR "b"')]
    assert r.parse_policy("nothing") == []
    assert r.split_top('("a" OR "Oracle OR") AND "b" AND ("c" AND "d")', "AND") == ['("a" OR "Oracle OR")', '"b"', '("c" AND "d")']


def test_policy_results(spark):
    docs = spark.createDataFrame([(1, "a.txt", TEXT), (2, "b.txt", "  "), (3, None, None), (4, "d", "acme only")], "doc_id bigint, name string, text string")
    got = {x["doc_id"]: x for x in matching.test_policy(docs, '## Rule 1: One\n`("ppe" OR "acme") AND "report"`\n## Rule 2: Two\n`"acme"`').collect()}
    assert [(k, v["readable"], v["matched_any"]) for k, v in sorted(got.items())] == [(1, True, True), (2, False, False), (3, False, False), (4, True, True)]
    assert [(m["rule_name"], m["hit_phrases"]) for m in got[1]["matched_rules"]] == [("One", ["acme", "ppe", "report"]), ("Two", ["acme"])]
    with pytest.raises(ValueError, match="no rules"):
        matching.test_policy(docs, "none")


def test_matchers_differ(spark):
    docs = matching.with_match_text(spark.createDataFrame([(1, "Vendor: ACME. x_po support"), (2, None)], "doc_id bigint, text string"))
    from phraseworks.functions import text as t

    lc = t.norm_lc(F.col("text"))
    got = docs.select(
        "doc_id", matching.phrase_in_tokens("vendor acme", F.col("match_text")).alias("a"), matching.phrase_present(lc, "vendor acme").alias("b"), matching.phrase_present(lc, "po").alias("c"),
        matching.phrase_in_tokens("po", F.col("match_text")).alias("d"), matching.phrase_present(lc, "acme. x_po").alias("e"),
    )
    assert rows(got) == [(1, True, False, False, True, True), (2, False, False, False, False, False)]


def test_equi_match_equals_search(spark):
    docs = spark.createDataFrame([(1, "the vendor acme; vendor, ACME"), (2, "acme"), (3, None)], "doc_id bigint, text string")
    phrases = spark.createDataFrame([("Vendor ACME",), ("acme",), ("***",), ("vendor acme vendor acme",)], "phrase string")
    assert rows(matching.phrases_in_documents(docs, phrases)) == [(1, "Vendor ACME"), (1, "acme"), (1, "vendor acme vendor acme"), (2, "acme")]


def test_same_after_repartition(spark):
    docs = spark.createDataFrame([(i, TEXT if i % 3 else "acme") for i in range(50)], "doc_id bigint, text string")
    policy = '## Rule 1: One\n`"vendor acme" OR "acme" AND "report"`'
    assert rows(matching.test_policy_flat(docs.repartition(7), policy)) == rows(matching.test_policy_flat(docs.coalesce(1), policy))
