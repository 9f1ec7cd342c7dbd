"""Grouping records into similarity clusters (problem 2).

Records are sparse 0/1 vectors of features (topics: their phrase keys), similar when their Jaccard similarity reaches 1/2;
clusters are what such links join, also over others.

Method: mergeable cluster features (n, linear sum, square sum) in trees per partition, leaf summaries reduced, Ward
agglomeration of leaves, one full assignment pass, members nearest the centroid as the typical ones. Minimum-variance
merging by itself does not reproduce the link relation the result is defined by, so a record is absorbed by a leaf, and a
leaf merged with another, only with one exactly similar pair as its witness.

1. Equal feature sets are collapsed to their least record.
2. Trees: each record goes to one partition, with others of the same min-hash feature (similar records do so with a
   probability of at least 1/2). A tree per such group: a record descends to the nearest leaf that holds a similar record,
   or opens a leaf; leaves are agglomerated in Ward's order. What leaves the partition is each record's leaf summary, its
   least record; no later step looks at pairs inside a leaf.
3. Summaries are reduced: records are routed by their rarest features (of n features the n - ceil(n/2) + 1 first in one
   global order, so any two similar records meet), counted per key together with the least and the greatest leaf. Keys
   that one leaf alone reaches are dropped before any feature is shuffled. The order follows counters of hash slots,
   tables of a fixed size.
4. A key of more than ``HOT`` records is split by further features, again and again: similar records under a key S of l
   features share a further one, unless their sizes sum to 3 l at most; then all of them are similar to the smallest
   record under S, to which they are linked (a minimum per key, nothing is gathered).
5. Leaves under one key are agglomerated as in 2. Candidates come from an index of the rarest features under the key, never
   from all pairs of leaves or records.
6. Links of leaves are merged to clusters (components), every record is assigned through its leaf, clusters get the sums of
   their features, and members are ranked by their distance to the centroid.

Defined results: records without features are clusters of their own; null features are not features; repeated rows count
once; an empty table gives no rows; ties go to the smaller record.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseworks.llm.components import components
from phraseworks.llm.distinct import phrase_rows
from phraseworks.session import cut_lineage

#: Records under a key beyond which it is split by further features, and how many features a key has at most.
HOT = 2000
MAX_DEPTH = 8
#: Powers of two between which the number of counter slots follows the number of records: at most 32 MB a table.
MIN_SLOTS, MAX_SLOTS = 16, 22
def similar(a: frozenset[int], b: frozenset[int]) -> bool:
    """Jaccard similarity of at least 1/2."""
    return 3 * len(a & b) >= len(a) + len(b)


class Leaf:
    """A cluster feature: the number of its members, their linear sum and square sum. Mergeable."""

    __slots__ = ("members", "n", "squares", "sums")

    def __init__(self, record: int, features: frozenset[int]):
        self.members, self.n, self.squares = [(record, features)], 1, len(features)
        self.sums = dict.fromkeys(features, 1)

    def add(self, record: int, features: frozenset[int], away: float = 0.0) -> None:  # noqa: ARG002
        self.members.append((record, features))
        self.n += 1
        self.squares += len(features)
        for f in features:
            self.sums[f] = self.sums.get(f, 0) + 1

    def merge(self, other: Leaf) -> None:
        self.members += other.members
        self.n += other.n
        self.squares += other.squares
        for f, c in other.sums.items():
            self.sums[f] = self.sums.get(f, 0) + c

    def ward(self, other: Leaf) -> float:
        """What merging the two would add to the summed squared distances from centroids."""
        small, large = (self, other) if len(self.sums) < len(other.sums) else (other, self)
        dot = sum(c * large.sums.get(f, 0) for f, c in small.sums.items()) / (self.n * other.n)
        own = sum(c * c for c in self.sums.values()) / self.n**2 + sum(c * c for c in other.sums.values()) / other.n**2
        return self.n * other.n / (self.n + other.n) * (own - 2 * dot)


def bucket_links(bucket: list[tuple[int, frozenset[int]]], roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join exactly the records of a bucket that similarity joins: at most one less than its leaves.

    ``roots``: the leaves the records are in already. Records are inserted one by one. Those similar to the new one are
    among the inserted ones that share a feature of its prefix in the order of rarity inside the bucket; the leaf of the
    nearest witness absorbs it, the leaves of the others are to be merged with that leaf, in Ward's order.
    """
    if len(bucket) == 2:
        (a, x), (b, y) = bucket
        return [(a, b)] if (roots is None or roots[0] != roots[1]) and similar(x, y) else []
    often = Counter(f for _, features in bucket for f in features)
    index: dict[int, dict[int, list[int]]] = {}  # by feature and leaf: the positions of records
    given: dict[int, int] = {}
    leaves: dict[int, Leaf] = {}
    links: list[tuple[int, int]] = []
    parent = list(range(len(bucket)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    waiting: list[tuple[float, int, int, int, int]] = []
    for i, (record, features) in enumerate(bucket):
        if roots is not None and (known := given.setdefault(roots[i], i)) != i:
            own = find(known)
            parent[i] = own
            leaves[own].add(record, features)
        else:
            own = i
        n = len(features)
        prefix = sorted(features, key=lambda f: (often[f], f))[: n - (n + 1) // 2 + 1]
        near: dict[int, tuple[float, int]] = {}  # by leaf: a similar record, and how far it is
        seen: set[int] = set()
        for f in prefix:
            for leaf, members in index.get(f, {}).items():
                leaf = find(leaf)
                if leaf == own or leaf in near:  # a leaf needs one witness only, however many members it has
                    continue
                for j in members:
                    if j not in seen:
                        seen.add(j)
                        other = bucket[j][1]
                        both = len(features & other)
                        if 3 * both >= n + len(other):
                            near[leaf] = (1 - both / (n + len(other) - both), j)
                            break
        if near and own == i:  # the nearest leaf absorbs the record
            leaf, (_, j) = min(near.items(), key=lambda x: x[1])
            del near[leaf]
            parent[i] = own = leaf
            leaves[leaf].add(record, features)
            links.append((bucket[j][0], record))
        elif own == i:
            leaves[i] = Leaf(record, features)
        for f in prefix:
            index.setdefault(f, {}).setdefault(own, []).append(i)
        for leaf, (_, j) in near.items():
            waiting.append((leaves[own].ward(leaves[leaf]), own, leaf, i, j))
        if len(waiting) >= 4 * len(leaves):  # no more than a few per leaf wait at a time
            _agglomerate(waiting, leaves, parent, find, bucket, links)
    _agglomerate(waiting, leaves, parent, find, bucket, links)
    return links


def _agglomerate(waiting: list, leaves: dict[int, Leaf], parent: list[int], find, bucket: list, links: list[tuple[int, int]]) -> None:
    """Merge leaves that a similar pair joins, the cheapest by Ward's cost first."""
    heapq.heapify(waiting)
    while waiting:
        _, a, b, i, j = heapq.heappop(waiting)
        a, b = sorted((find(a), find(b)))
        if a != b:
            leaves[a].merge(leaves.pop(b))
            parent[b] = a
            links.append((bucket[j][0], bucket[i][0]))


_LINKS = "u bigint, v bigint"
_LINKS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_ROOTED = "record bigint, root bigint, features array<bigint>"
_ROOTED_ARROW = pa.schema([("record", pa.int64()), ("root", pa.int64()), ("features", pa.list_(pa.int64()))])
_ENTRIES = "bucket bigint, record bigint, root bigint, features array<bigint>"
_ENTRIES_ARROW = pa.schema([("bucket", pa.int64()), ("record", pa.int64()), ("root", pa.int64()), ("features", pa.list_(pa.int64()))])
_MEMBERS = "bucket bigint, level int, size int, root bigint"
_MEMBERS_ARROW = pa.schema([("bucket", pa.int64()), ("level", pa.int32()), ("size", pa.int32()), ("root", pa.int64())])


class Forest(dict):
    """Union-find over the records a task has linked."""

    def root(self, k: int) -> int:
        while (up := self.setdefault(k, k)) != k:
            self[k] = self[up]
            k = up
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, at = column.flatten().to_numpy(zero_copy_only=False), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _groups(batches: Iterator[pa.RecordBatch], key: str, *columns: str) -> Iterator[list[tuple]]:
    """The rows of each run of equal keys of a partition that is sorted by ``key``; arrays are views, not lists."""
    now, rows = None, []
    for batch in batches:
        for k, *row in zip(*(_values(batch[c]) for c in (key, *columns)), strict=True):
            if k != now:
                if rows:
                    yield rows
                now, rows = k, []
            rows.append(row)
    if rows:
        yield rows


def _tree_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree per group of the partition, which is sorted by ``home``: each record with the least record of its leaf."""
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_ROOTED_ARROW)], schema=_ROOTED_ARROW)
        out.clear()
        return made

    for rows in _groups(batches, "home", "record", "features"):
        forest = Forest()
        if len(rows) > 1:
            for a, b in bucket_links([(r, frozenset(x.tolist())) for r, x in rows]):
                forest.join(a, b)
        out += [(r, forest.root(r), x) for r, x in rows]
        if len(out) > 10_000:
            yield emit()
    yield emit()


def _link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition is sorted by bucket. Links between leaves that the task has joined already are not emitted again."""
    found, forest = [], Forest()

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=_LINKS_ARROW)
        found.clear()
        return made

    for rows in _groups(batches, "bucket", "record", "root", "features"):
        if len({root for _, root, _ in rows}) > 1 and len({forest.root(root) for _, root, _ in rows}) > 1:
            bucket = {r: frozenset(x.tolist()) for r, _, x in rows}
            own = {r: root for r, root, _ in rows}
            for a, b in bucket_links([*bucket.items()], [forest.root(own[r]) for r in bucket]):
                if forest.join(own[a], own[b]):
                    found.append((own[a], own[b]))
        if len(found) > 50_000:
            yield emit()
    yield emit()


def feature_sets(terms: DataFrame) -> DataFrame:
    """``(record, features)``: each record's distinct terms as sorted 64-bit hashes; repeated terms go before the shuffle."""
    return terms.where("record is not null and term is not null").groupBy("record").agg(F.array_sort(F.collect_set(F.xxhash64("term"))).alias("features"))


class Prefixes:
    """The records of a batch with their features in one global order: those of the least counters first, ties by hash."""

    def __init__(self, batch: pa.RecordBatch, counters: np.ndarray | None):
        column = batch["features"]
        self.flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = np.diff(column.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        if counters is not None:
            order = np.lexsort((self.flat, counters[slot(self.flat, len(counters))], self.row))
            self.flat = self.flat[order]
            self.place = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
            self.prefix = self.size - (self.size + 1) // 2 + 1


def slot(features: np.ndarray, slots: int) -> np.ndarray:
    return (features.astype(np.uint64) % np.uint64(slots)).astype(np.int64)


def _key(features: list[int]) -> int:
    return xxhash.xxh64_intdigest(" ".join(map(str, sorted(features)))) - (1 << 63)


#: States of the keys of a hash slot: nothing to do, few records, many.
DEAD, FEW, MANY = 0, 1, 2


class Keys:
    """The keys of a batch of records. ``states[l - 1]`` are those of keys of l features, as far as they are known."""

    def __init__(self, batch: pa.RecordBatch, counters: np.ndarray, states: list[np.ndarray]):
        self.p, self.states, self.slots = Prefixes(batch, counters), states, len(counters)
        first = np.flatnonzero(self.p.place < self.p.prefix[self.p.row])
        self.first, self.row = self.p.flat[first], self.p.row[first]
        self.starts = np.cumsum(self.p.size) - self.p.size
        self.at = self.p.place[first]

    def single(self) -> np.ndarray:
        return self.states[0][slot(self.first, self.slots)]

    def longer(self) -> Iterator[tuple[int, int, int, int]]:
        """``(row, level, key, state)`` of keys below those that many records have; state -1 where it is not known."""
        for i in np.flatnonzero(self.single() == MANY).tolist():
            r = int(self.row[i])
            n, begin = int(self.p.size[r]), int(self.starts[r])
            features = self.p.flat[begin : begin + n].tolist()
            yield from self._below(r, features, [int(self.at[i])], int(self.p.prefix[r]))

    def _below(self, r: int, features: list[int], places: list[int], prefix: int) -> Iterator[tuple[int, int, int, int]]:
        level = len(places) + 1
        known = len(self.states) >= level
        for j in range(places[-1] + 1, min(len(features), prefix + level - 1)):
            key = _key([features[k] for k in (*places, j)])
            state = int(self.states[level - 1][key % self.slots]) if known else -1
            if state != DEAD:
                yield r, level, key, state
            if state == MANY:
                yield from self._below(r, features, [*places, j], prefix)


def _summed(rows: DataFrame, slots: int, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """``(slot, n, lo, hi)`` of what ``make`` gives: slots, and the leaves that reach them; at most ``slots`` rows a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max), np.full(slots, np.iinfo(np.int64).min)
        for at, root in make(batches):
            n += np.bincount(at, minlength=slots)
            np.minimum.at(lo, at, root)
            np.maximum.at(hi, at, root)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(lo[at]), pa.array(hi[at])], names=["slot", "n", "lo", "hi"])

    return rows.mapInArrow(count, "slot bigint, n bigint, lo bigint, hi bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _counters(sets: DataFrame, slots: int) -> np.ndarray:
    """In how many sets the features of each slot are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            flat = Prefixes(batch, None).flat
            yield slot(flat, slots), np.zeros(len(flat), np.int64)

    summed = _summed(sets.select("features"), slots, make).select("slot", "n").toPandas()
    made = np.zeros(slots, np.int32)
    made[summed["slot"].to_numpy()] = np.minimum(summed["n"].to_numpy(), np.iinfo(np.int32).max)
    return made


def _key_states(rooted: DataFrame, shared: Broadcast, level: int, states: list[np.ndarray], hot: int, slots: int) -> np.ndarray:
    """The states of the slots of keys of ``level`` features: of fixed size, whatever the data hold."""
    known = rooted.sparkSession.sparkContext.broadcast(states)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            root = batch["root"].to_numpy()
            keys = Keys(batch, shared.value, known.value)
            if level == 1:
                yield slot(keys.first, slots), root[keys.row]
            elif found := [(key % slots, root[r]) for r, depth, key, _ in keys.longer() if depth == level]:
                yield np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)

    alive = _summed(rooted, slots, make).where("n > 1 and lo < hi").select("slot", (F.col("n") > hot).alias("many")).toPandas()
    made = np.zeros(slots, np.int8)
    made[alive["slot"].to_numpy()] = np.where(alive["many"].to_numpy().astype(bool) & (level < MAX_DEPTH), MANY, FEW)
    return made


def _homes(sets: DataFrame, shared: Broadcast, hot: int) -> DataFrame:
    """``(home, record, features)``: one partition key per record, its least feature by a hash among those that few records have."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, counters = Prefixes(batch, None), shared.value
            often = counters[slot(p.flat, len(counters))]
            order = (p.flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            order = np.where((often > 1) & (often <= hot), order, np.uint64(1 << 63) | order)
            first = np.lexsort((order, p.row))[np.cumsum(p.size) - p.size]
            # a record without such a feature is a group by itself: its key is that of all its features
            alone = np.flatnonzero(order[first] >= np.uint64(1 << 63))
            home = p.flat[first].copy()
            begin = np.cumsum(p.size) - p.size
            home[alone] = [_key(p.flat[begin[r] : begin[r] + p.size[r]].tolist()) for r in alone.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(home), batch["record"], batch["features"]], names=["home", "record", "features"])

    return sets.mapInArrow(place, "home bigint, record bigint, features array<bigint>")


def _entries(rooted: DataFrame, shared: Broadcast, known: Broadcast) -> DataFrame:
    """``(bucket, record, root, features)``: records under the keys that few records, of different leaves, have."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = Keys(batch, shared.value, known.value)
            few = np.flatnonzero(keys.single() == FEW)
            longer = [(key, r) for r, _, key, state in keys.longer() if state == FEW]
            bucket = np.concatenate([keys.first[few], np.array([x[0] for x in longer], np.int64)])
            row = np.concatenate([keys.row[few], np.array([x[1] for x in longer], np.int64)])
            for a in range(0, len(row), 10_000):
                part = pa.array(row[a : a + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 10_000]), *(batch[c].take(part) for c in ("record", "root", "features"))], schema=_ENTRIES_ARROW)

    return rooted.mapInArrow(route, _ENTRIES)


def _small_links(rooted: DataFrame, shared: Broadcast, known: Broadcast) -> DataFrame:
    """``(u, v)``: under a key S of l features that many records have, those whose size and the smallest one's sum to 3 l at most."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, root = Keys(batch, shared.value, known.value), batch["root"].to_numpy()
            found = [(int(keys.first[i]), 1, int(keys.row[i])) for i in np.flatnonzero(keys.single() == MANY).tolist()]
            found += [(key, level, r) for r, level, key, state in keys.longer() if state == MANY]
            rows = [(key, level, int(keys.p.size[r]), int(root[r])) for key, level, r in found if keys.p.size[r] < 3 * level]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_MEMBERS_ARROW)], schema=_MEMBERS_ARROW)

    under = rooted.mapInArrow(members, _MEMBERS)
    least = under.groupBy("bucket", "level").agg(F.min(F.struct("size", "root")).alias("least"))
    return under.join(least, ["bucket", "level"]).where("size + least.size <= 3 * level and root <> least.root").select(F.col("root").alias("u"), F.col("least.root").alias("v"))


def links(sets: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(rooted, edges)``: ``(record, root)`` of distinct ``sets (record, features)`` by leaves, and ``(u, v)`` between their roots.

    Together they join exactly the records that similarity joins. The root of a leaf is its least record.
    """
    n = sets.count()
    slots = 1 << min(MAX_SLOTS, max(MIN_SLOTS, (4 * n).bit_length()))
    context = sets.sparkSession.sparkContext
    shared = context.broadcast(_counters(sets, slots))
    homes = _homes(sets, shared, hot).repartition("home").sortWithinPartitions("home")
    rooted = cut_lineage(homes.mapInArrow(_tree_partition, _ROOTED))
    states: list[np.ndarray] = []
    while not states or (states[-1] == MANY).any():
        states.append(_key_states(rooted, shared, len(states) + 1, states, hot, slots))
    known = context.broadcast(states)
    edges = _entries(rooted, shared, known).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_partition, _LINKS)
    if len(states) > 1:
        edges = edges.unionAll(_small_links(rooted, shared, known))
    return rooted.select("record", "root"), edges


def cluster(terms: DataFrame, records: DataFrame) -> DataFrame:
    """``(record, cluster)`` of every record of ``records (record)``; cluster is its least record."""
    signed = cut_lineage(feature_sets(terms).withColumn("signature", F.xxhash64("features", F.size("features"))))
    leading = cut_lineage(signed.groupBy("signature").agg(F.min("record").alias("record"), F.first("features").alias("features")))
    rooted, edges = links(leading.select("record", "features"))
    joined = components(edges).select(F.col("node").alias("root"), F.col("root").alias("least"))
    assigned = rooted.join(joined, "root", "left").select("record", F.coalesce("least", "root").alias("cluster"))
    by_set = leading.select("signature", "record").join(assigned, "record").select("signature", "cluster")
    every = records.select("record").where("record is not null").distinct()
    placed = signed.select("record", "signature").join(by_set, "signature").select("record", "cluster")
    return every.join(placed, "record", "left").select("record", F.coalesce("cluster", "record").alias("cluster"))


def distances(terms: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every member's distance to the centroid of its cluster: ``(cluster, record, distance, n_records)``.

    The merged cluster feature of a cluster is, per term, in how many members it is; a member's squared distance to the
    centroid follows from sums over its own terms. Counts are pre-aggregated per (cluster, term).
    """
    held = terms.where("record is not null and term is not null").select("record", F.xxhash64("term").alias("h")).distinct().join(assigned, "record")
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n_records"))
    sums = held.groupBy("cluster", "h").agg(F.count("*").alias("c"))
    norms = sums.groupBy("cluster").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("square"))
    own = held.join(sums, ["cluster", "h"]).groupBy("cluster", "record").agg(F.sum("c").alias("dot"), F.count("*").alias("size"))
    placed = assigned.join(own, ["cluster", "record"], "left").join(sizes, "cluster").join(norms, "cluster", "left")
    zero = F.lit(0.0)
    squared = F.coalesce(F.col("size"), zero) - 2 * F.coalesce(F.col("dot"), zero) / F.col("n_records") + F.coalesce(F.col("square"), zero) / (F.col("n_records") * F.col("n_records"))
    away = F.round(F.sqrt(F.greatest(squared, zero)), 9)
    return placed.select("cluster", "record", away.alias("distance"), "n_records")


def nearest(placed: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` first members of each cluster of ``placed (cluster, record, distance, ...)``, with their ``rank``."""
    w = Window.partitionBy("cluster").orderBy("distance", "record")
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def typical(terms: DataFrame, assigned: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` members nearest the centroid of each cluster: ``(cluster, record, distance, n_records, rank)``."""
    return nearest(distances(terms, assigned), k)


def topic_terms(phrases: DataFrame) -> DataFrame:
    """``(record, term)``: topics and the keys of their phrases."""
    return phrase_rows(phrases).select("record", "term")


def topic_clusters(topics: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(topic_key, cluster)`` of every topic."""
    records = topics.select(F.col("topic_key").alias("record"))
    return cluster(topic_terms(phrases), records).select(F.col("record").alias("topic_key"), "cluster")


def describe_topics(topics: DataFrame, previews: DataFrame, phrases: DataFrame, k: int = 3) -> DataFrame:
    """Clusters of topics: ``(cluster, n_topics, n_docs, name, typical)``, the name and members nearest the centroid first.

    ``n_docs`` counts the documents of the topics once (a doc_id is one document); the name is that of the nearest of all
    members whose latest preview has one that is not a default name; ``typical`` has ``k`` of them.
    """
    terms = cut_lineage(topic_terms(phrases).distinct())
    records = topics.select(F.col("topic_key").alias("record"))
    assigned = cut_lineage(cluster(terms, records))
    docs = topics.select(F.col("topic_key").alias("record"), F.explode("doc_ids").alias("doc")).join(assigned, "record").select("cluster", "doc").distinct().groupBy("cluster").agg(F.count("*").alias("n_docs"))
    named = previews.where("name is not null").groupBy("topic_key").agg(F.max_by("name", F.struct("loaded_at", "name")).alias("name"))
    good = ~F.lower("name").rlike(r"^\s*(?:topic \d+|general topic|untitled topic|single document topic)\s*$")
    placed = cut_lineage(distances(terms, assigned))
    names = placed.join(named.where(good).withColumnRenamed("topic_key", "record"), "record").groupBy("cluster").agg(F.min_by("name", F.struct("distance", "record")).alias("name"))
    head = nearest(placed, k).groupBy("cluster").agg(
        F.max("n_records").alias("n_topics"),
        F.array_sort(F.collect_list(F.struct("rank", "record"))).alias("members"),  # at most k
    )
    described = head.join(names, "cluster", "left").join(docs, "cluster", "left")
    return described.select("cluster", "n_topics", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "name", F.transform("members", lambda m: m["record"]).alias("typical"))
