import random
from collections import Counter
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from phraseworks.llm import terms
from tests.conftest import rows

AT = [datetime(2024, 1, d) for d in range(1, 5)]
RUNS = "run_id bigint, n_docs int, loaded_at timestamp"
TERMS = "run_id bigint, term string, tf bigint, df bigint, loaded_at timestamp, mark string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcسé\U0001f600", max_size=6), max_size=80), st.integers(1, 5), st.integers(1, 20))
def test_trie_counts_and_packs(words, burst, block):
    trie = terms.BurstTrie(burst)
    for w in words:
        trie.add(w, 2, 1)
    want = {w: [2 * n, n] for w, n in Counter(words).items()}
    assert dict(trie.items()) == want and trie.size == len(want)
    assert [w for w, _ in trie.items()] == sorted(want)
    blocks = [*trie.subtrees(block)]
    assert {w: [tf, df] for p, _, b in blocks for w, tf, df in terms.unpack(p, b)} == want
    assert sum(n for _, n, _ in blocks) == len(want) and all(w.startswith(p) for p, _, b in blocks for w, _, _ in terms.unpack(p, b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=5), min_size=1, max_size=30), st.sets(st.text("ab", max_size=2)))
def test_one_route_for_a_term_whatever_its_block(words, heavy):
    heavy = frozenset(heavy | {""})
    for w in words:
        for k in range(len(w) + 1):  # a block of prefix w[:k] either decides the route or is split
            route = terms.route_of(w[:k], heavy)
            assert route == terms.route_of(w, heavy) or (route in heavy and route == w[:k])


def test_counts_over_partitions(spark, monkeypatch):
    random.seed(1)
    data = [("hot" if i % 3 == 0 else "".join(random.choice("abcde") for _ in range(random.randint(1, 4))), 1, 1) for i in range(6000)]
    df = spark.createDataFrame(data, "term string, tf bigint, df bigint").repartition(6)
    want = sorted(((w, n, n) for w, n in Counter(w for w, _, _ in data).items()), key=repr)
    assert rows(terms.count_terms(df)) == want
    monkeypatch.setattr(terms, "BLOCK", 8)  # many heavy prefixes and split blocks
    assert rows(terms.count_terms(df)) == want


def test_marks(spark):
    runs = spark.createDataFrame([(1, 6, AT[0]), (1, 6, AT[1]), (2, 4, None), (None, 100, AT[0])], RUNS)
    data = [
        (1, " The ", 9, 5, AT[0], "x"), (1, "the", 7, 4, AT[1], None), (2, "THE", 1, 1, None, None), (1, "rare", 1, 1, AT[0], None), (1, "rare", 1, 1, AT[0], None), (2, "rare", 2, 1, AT[0], None),
        (1, "mid", 3, 3, AT[0], None), (1, None, 3, 3, AT[3], None), (1, "mid", None, 9, AT[3], None), (1, "mid", 9, None, AT[3], None), (1, "tie", 3, 1, AT[0], None), (1, "tie", 2, 3, AT[0], None), (1, "  ", 1, 1, AT[0], None),
    ]
    got = {r["term"]: tuple(r)[1:] for r in terms.term_frequencies(spark.createDataFrame(data, TERMS), runs).collect()}
    assert got == {"the": (8, 5, 0.5, "common"), "rare": (3, 2, 0.2, "rare"), "mid": (3, 3, 0.3, None), "tie": (3, 3, 0.3, None), "": (1, 1, 0.1, "rare")}


def test_empty(spark):
    empty = terms.term_frequencies(spark.createDataFrame([], TERMS), spark.createDataFrame([], RUNS))
    assert empty.count() == 0 and empty.columns == ["term", "tf", "df", "df_ratio", "mark"]
    long = "x" * 100_000
    got = terms.count_terms(spark.createDataFrame([(long, 1, 1), (long, 2, 1)], "term string, tf bigint, df bigint"))
    assert rows(got) == [(long, 3, 2)]
