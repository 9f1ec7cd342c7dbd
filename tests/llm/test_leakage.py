import random

from hypothesis import given, settings
from hypothesis import strategies as st

from phraseworks.llm import leakage
from tests.conftest import rows


def brute(words, items, run):
    grams = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
    return {k for k, t in items for w in [leakage.words_of(t)] if grams & {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=4), st.text("abc ", max_size=60), st.integers(2, 5))
def test_equals_brute_force(texts, text, run):
    items = [*enumerate(texts)]
    assert leakage.WuManber(items, run).search(leakage.words_of(text)) == brute(leakage.words_of(text), items, run)


def test_leaks(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(r.choices(words, k=30))) for k in range(20)] + [(20, "too short"), (21, None)]
    items.append((22, items[0][1]))  # asks about the same passage again
    docs = [(100 + k, f"{' '.join(r.choices(words, k=20))}, {' '.join(items[k][1].split()[5 : 5 + n]).upper()}! end", "x") for k, n in ((0, 12), (1, 11), (2, 25), (3, 30))]
    docs += [(200, None, "x"), (201, "", "x"), (202, "w1 " * 100_000 + items[4][1], "x"), (100, docs[0][1], "x")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(100, 0), (100, 22), (102, 2), (103, 3), (202, 4)]
    assert rows(leakage.leaked(documents, table)) == want
    assert rows(leakage.leaked(documents.repartition(5), table, max_pattern_words=100)) == want  # several passes
    assert leakage.leaked(documents, table.where("false")).count() == 0 and leakage.leaked(documents.where("false"), table).count() == 0
