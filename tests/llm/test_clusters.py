import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phraseworks.llm import clusters, components
from tests.conftest import rows


def brute(sets):
    """Least member of each set's component under Jaccard similarity of at least 1/2."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 2 * both >= len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def frames(spark, sets):
    return (
        spark.createDataFrame([(k, f) for k, s in sets.items() for f in s for _ in range(2)], "record bigint, term string"),
        spark.createDataFrame([(k, "x") for k in sets], "record bigint, cluster string"),
    )


def generated(seed, n=120):
    r = random.Random(seed)
    base = [frozenset(r.sample([f"f{i}" for i in range(200)], r.randint(1, 8))) for _ in range(n // 6)]
    sets = {}
    for k in range(n):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 3)):
            s ^= {r.choice(["hot", "warm", f"f{r.randint(0, 200)}"])}
        if k % 3 == 0:
            s.add("hot")
        sets[k] = frozenset(s)
    sets[n] = frozenset()
    return sets


@pytest.mark.parametrize("hot", [2000, 5])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(clusters.links, "__defaults__", (hot,))
    for seed in (1, 2):
        sets = generated(seed)
        terms, records = frames(spark, sets)
        assert dict(rows(clusters.cluster(terms, records))) == brute(sets)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1, max_size=7), min_size=2, max_size=25))
def test_bucket_links_join_what_similarity_joins(sets):
    bucket = [*enumerate(sets)]
    links = clusters.bucket_links(bucket)
    assert all(clusters.similar(sets[a], sets[b]) for a, b in links) and len(links) < len(bucket)
    want = brute({k: s for k, s in bucket})
    root = {k: k for k in want}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert root == want


def test_ward_cost_is_the_added_square_sum():
    a, b = clusters.Leaf(1, frozenset([1, 2])), clusters.Leaf(2, frozenset([2, 3, 4]))
    a.add(3, frozenset([1, 2, 5]), 0.3)

    def scatter(sets):
        feats = sorted(set().union(*sets))
        means = [sum(f in s for s in sets) / len(sets) for f in feats]
        return sum(((f in s) - m) ** 2 for s in sets for f, m in zip(feats, means, strict=True))

    x, y = [s for _, s in a.members], [s for _, s in b.members]
    assert abs(a.ward(b) - (scatter(x + y) - scatter(x) - scatter(y))) < 1e-9
    assert a.n == 2 and a.squares == 5


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (7, 7), (200, 100)]
    got = dict(rows(components.components(spark.createDataFrame(path, "u bigint, v bigint"))))
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_typical_members_are_nearest_the_centroid(spark):
    sets = {1: {"a", "b", "c"}, 2: {"a", "b", "c"}, 3: {"a", "b", "c", "d"}, 4: {"a", "b"}, 9: set()}
    terms, records = frames(spark, sets)
    got = rows(clusters.typical(terms, clusters.cluster(terms, records)).select("cluster", "rank", "record", "n_records"))
    assert got == [(1, 1, 1, 4), (1, 2, 2, 4), (1, 3, 3, 4), (9, 1, 9, 1)]  # 3 and 4 are equally far


def test_topics(spark):
    topics = spark.createDataFrame([(1, [10, 11], "s"), (2, [11], "s"), (3, [], None), (4, None, None)], "topic_key bigint, doc_ids array<bigint>, name string")
    phrases = spark.createDataFrame([(1, 1, 1, "Pump  Seal", 0.1), (2, 2, 1, "ｐｕｍｐ seal", None), (2, 2, 1, "ｐｕｍｐ seal", None), (3, 3, 1, None, 0.1), (4, 4, 1, "other", 0.2)], "phrase_id bigint, topic_key bigint, phrase_rank int, text string, df_ratio double")
    previews = spark.createDataFrame([(1, "Topic 1", None), (2, "Pumps", None), (2, None, None)], "topic_key bigint, name string, loaded_at timestamp")
    assert rows(clusters.topic_clusters(topics, phrases)) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    got = {r["cluster"]: tuple(r)[1:] for r in clusters.describe_topics(topics, previews, phrases).collect()}
    assert got == {1: (2, 2, "Pumps", [1, 2]), 3: (1, 0, None, [3]), 4: (1, 0, None, [4])}
    assert clusters.topic_clusters(topics.where("false"), phrases.where("false")).count() == 0


def test_a_name_is_sought_among_all_members(spark):
    topics = spark.createDataFrame([(k, [k]) for k in range(1, 7)], "topic_key bigint, doc_ids array<bigint>")
    phrases = spark.createDataFrame([(k, k, 1, "pump seal", 0.1) for k in range(1, 7)], "phrase_id bigint, topic_key bigint, phrase_rank int, text string, df_ratio double")
    previews = spark.createDataFrame([(1, "Topic 1", None), (2, None, None), (3, "general topic", None), (5, "Pumps", None), (6, "Seals", None)], "topic_key bigint, name string, loaded_at timestamp")
    assert rows(clusters.describe_topics(topics, previews, phrases)) == [(1, 6, 6, "Pumps", [1, 2, 3])]


def test_a_link_of_exactly_one_half_survives_rounding():
    bucket = [(1, frozenset([1, 2, 3, 4, 5])), (2, frozenset([1, 2, 3, 4, 5, 6])), (3, frozenset([4, 5, 6]))]
    assert clusters.similar(bucket[1][1], bucket[2][1]) and not clusters.similar(bucket[0][1], bucket[2][1])
    links = clusters.bucket_links(bucket)
    assert len(links) == 2 and (2, 3) in {tuple(sorted(x)) for x in links}


def test_a_large_bucket_of_dissimilar_records_is_no_matter_of_all_pairs():
    r = random.Random(5)
    bucket = [(k, frozenset([-1, -2, *r.sample(range(100_000), 6)])) for k in range(20_000)]
    bucket += [(20_000 + k, bucket[k][1] | {-3}) for k in range(5)]
    began = time.perf_counter()
    assert sorted(tuple(sorted(x)) for x in clusters.bucket_links(bucket)) == [(k, 20_000 + k) for k in range(5)]
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("hot", [2000, 3])
def test_features_that_many_share(spark, monkeypatch, hot):
    """Small sets of the same few features, and sets that share up to four hot ones."""
    monkeypatch.setattr(clusters.links, "__defaults__", (hot,))
    r = random.Random(7)
    warm = ["h1", "h2", "h3", "h4"]
    sets = {k: frozenset([*r.sample(warm, r.randint(1, 4)), *(f"x{r.randint(0, 400)}" for _ in range(r.randint(0, 5)))]) for k in range(150)}
    terms, records = frames(spark, sets)
    assert dict(rows(clusters.cluster(terms, records))) == brute(sets)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.frozensets(st.integers(0, 9), min_size=1, max_size=6), st.integers(0, 4)), min_size=2, max_size=20))
def test_leaves_that_are_joined_already(given_sets):
    """With known leaves the links join what similarity and the leaves join together, and no leaf to itself."""
    bucket, roots = [(k, s) for k, (s, _) in enumerate(given_sets)], [k for _, k in given_sets]
    links = clusters.bucket_links(bucket, roots)
    root = dict(enumerate(roots))
    for a, b in links:
        assert clusters.similar(bucket[a][1], bucket[b][1]) and root[a] != root[b]
        root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    assert all(root[i] == root[j] for i, x in bucket for j, y in bucket if clusters.similar(x, y))
