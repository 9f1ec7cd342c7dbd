"""Frequency of every distinct term, by burst-trie counting (problem 1).

Every worker counts the terms of its partitions in a burst trie: containers of suffixes that burst into a deeper trie node
when they hold too many, so prefixes are as deep as the data makes them. A worker emits its trie as compact front-coded
subtrees and, in a bounded histogram, the weight of its heavy prefixes. The summed histogram gives the routing prefixes:
``route(term)`` is the longest heavy prefix of the term and one character more, the same on every worker. Subtrees that
match a route are shuffled to one task and merged there. What counting shuffles is one entry per distinct term and worker,
so a term that fills a third of all rows costs no more than any other. Before that, ``latest_rows`` shuffles all rows once,
by run and term, since only the latest row of each counts.

Defined results: rows with a null term, tf or df do not count; terms are trimmed and lower-cased; per (group, term) the
row with the latest load time counts (null load times are earliest; at equal times the greatest tf and the greatest df);
an empty table gives no rows; a term of blanks is the empty term.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseworks.session import cut_lineage

#: A container bursts beyond this many suffixes.
BURST = 512
#: A subtree of at most this many terms is emitted as one block.
BLOCK = 8192
#: A worker's trie is emitted and begun anew beyond this many terms, which bounds its memory.
FLUSH = 1_000_000
#: Each worker reports prefixes that hold at least this share of its terms: at most its inverse per level.
HEAVY_SHARE = 1 / 512


class BurstTrie:
    """Counters (tf, df) by term. A node is ``[own counters or None, {character: node or container}]``, a container a dict by suffix."""

    def __init__(self, burst: int = BURST):
        self.burst, self.size = burst, 0
        self.root: list = [None, {}]

    def add(self, term: str, tf: int, df: int) -> None:
        node, i, n = self.root, 0, len(term)
        while i < n:
            kids = node[1]
            child = kids.get(term[i])
            if child is None:
                child = kids[term[i]] = {}
            i += 1
            if type(child) is dict:
                suffix = term[i:]
                cell = child.get(suffix)
                if cell is not None:
                    cell[0] += tf
                    cell[1] += df
                    return
                child[suffix] = [tf, df]
                self.size += 1
                if len(child) > self.burst:
                    kids[term[i - 1]] = self._burst(child)
                return
            node = child
        if node[0] is None:
            node[0] = [tf, df]
            self.size += 1
        else:
            node[0][0] += tf
            node[0][1] += df

    @staticmethod
    def _burst(container: dict) -> list:
        node: list = [container.pop("", None), {}]
        for suffix, cell in container.items():
            node[1].setdefault(suffix[0], {})[suffix[1:]] = cell
        return node

    def _items(self, node: list | dict, prefix: str) -> Iterator[tuple[str, list[int]]]:
        if type(node) is dict:
            for suffix in sorted(node):
                yield prefix + suffix, node[suffix]
            return
        if node[0] is not None:
            yield prefix, node[0]
        for ch in sorted(node[1]):
            yield from self._items(node[1][ch], prefix + ch)

    def items(self) -> Iterator[tuple[str, list[int]]]:
        return self._items(self.root, "")

    def _count(self, node: list | dict, prefix: str, sizes: dict[str, int]) -> int:
        if type(node) is dict:
            return len(node)
        n = (node[0] is not None) + sum(self._count(child, prefix + ch, sizes) for ch, child in node[1].items())
        sizes[prefix] = n
        return n

    def subtrees(self, block: int = BLOCK) -> Iterator[tuple[str, int, bytes]]:
        """``(prefix, terms, block)`` of the largest subtrees that fit a block; the terms that end at nodes above them by themselves."""
        sizes: dict[str, int] = {}
        self._count(self.root, "", sizes)

        def walk(node: list | dict, prefix: str) -> Iterator[tuple[str, int, bytes]]:
            n = len(node) if type(node) is dict else sizes[prefix]
            if n and (type(node) is dict or (n <= block and prefix)):
                yield prefix, n, pack(list(self._items(node, prefix)), len(prefix))
            elif type(node) is list:
                if node[0] is not None:
                    yield prefix, 1, pack([(prefix, node[0])], len(prefix))
                for ch in sorted(node[1]):
                    yield from walk(node[1][ch], prefix + ch)

        yield from walk(self.root, "")

    def heavy(self, share: float = HEAVY_SHARE) -> Iterator[tuple[str, int]]:
        sizes: dict[str, int] = {}
        least = max(1, int(self._count(self.root, "", sizes) * share))
        return ((p, n) for p, n in sizes.items() if n >= least)


def pack(items: list[tuple[str, list[int]]], skip: int) -> bytes:
    """Front-coded block of sorted terms without their first ``skip`` characters, with their counters."""
    shared, tails, before = [], [], ""
    for term, _ in items:
        k, top = skip, min(len(term), len(before))
        while k < top and term[k] == before[k]:
            k += 1
        shared.append(k - skip)
        tails.append(term[k:].encode("utf-8", "surrogatepass"))
        before = term
    counters = np.array([c for _, c in items], np.int64)
    lengths = np.array([shared, [len(t) for t in tails]], np.uint32)
    return zlib.compress(struct.pack("<I", len(items)) + lengths.tobytes() + counters.tobytes() + b"".join(tails), 1)


def unpack(prefix: str, block: bytes) -> Iterator[tuple[str, int, int]]:
    data = zlib.decompress(block)
    (n,) = struct.unpack_from("<I", data)
    shared, sizes = np.frombuffer(data, np.uint32, 2 * n, 4).reshape(2, n).tolist()
    counters = np.frombuffer(data, np.int64, 2 * n, 4 + 8 * n).reshape(n, 2).tolist()
    at, before = 4 + 24 * n, ""
    for k, size, (tf, df) in zip(shared, sizes, counters, strict=True):
        before = before[:k] + data[at : at + size].decode("utf-8", "surrogatepass")
        at += size
        yield prefix + before, tf, df


_PARTIAL = "prefix string, terms bigint, block binary"
_ROUTED = "route string, prefix string, block binary"
_COUNTS = "term string, tf bigint, df bigint"
_PARTIAL_ARROW = pa.schema([("prefix", pa.string()), ("terms", pa.int64()), ("block", pa.binary())])
_ROUTED_ARROW = pa.schema([("route", pa.string()), ("prefix", pa.string()), ("block", pa.binary())])
_COUNTS_ARROW = pa.schema([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())])


def _batches(rows: list, schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), size):
        columns = zip(*rows[a : a + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, waiting, rows = BurstTrie(), [], 0

    def take() -> None:
        if waiting:
            sums = pa.Table.from_batches(waiting).group_by("term", use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
            for term, tf, df in zip(sums["term"].to_pylist(), sums["tf_sum"].to_pylist(), sums["df_sum"].to_pylist(), strict=True):
                trie.add(term, tf, df)
            waiting.clear()

    def emit() -> Iterator[pa.RecordBatch]:
        yield from _batches([*trie.subtrees()], _PARTIAL_ARROW, 256)
        yield from _batches([(p, n, None) for p, n in trie.heavy()], _PARTIAL_ARROW)

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= 200_000:
            take()
            rows = 0
            if trie.size >= FLUSH:
                yield from emit()
                trie = BurstTrie()
    take()
    yield from emit()


def route_of(term: str, heavy: frozenset[str]) -> str:
    """The longest prefix in ``heavy`` that begins ``term`` from the root on, and one character more."""
    k = 0
    while k < len(term) and term[:k] in heavy:
        k += 1
    return term[:k]


def _router(heavy: frozenset[str]):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix, block in zip(batch["prefix"].to_pylist(), batch["block"].to_pylist(), strict=True):
                if block is None:
                    continue
                route = route_of(prefix, heavy)
                if route not in heavy or not prefix.startswith(route) or len(prefix) > len(route):
                    rows.append((route, prefix, block))
                    continue
                parts: dict[str, list] = {}  # the block spans several routes
                for term, tf, df in unpack(prefix, block):
                    parts.setdefault(route_of(term, heavy), []).append((term, [tf, df]))
                rows += [(r, prefix, pack(items, len(prefix))) for r, items in parts.items()]
            yield from _batches(rows, _ROUTED_ARROW, 256)

    return split


def _merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition is sorted by route: the subtrees of one route are merged at a time."""
    route, trie = None, BurstTrie()

    def emit() -> Iterator[pa.RecordBatch]:
        yield from _batches([(t, c[0], c[1]) for t, c in trie.items()], _COUNTS_ARROW, 10_000)

    for batch in batches:
        for r, prefix, block in zip(*(batch[c].to_pylist() for c in ("route", "prefix", "block")), strict=True):
            if r != route:
                yield from emit()
                route, trie = r, BurstTrie()
            for term, tf, df in unpack(prefix, block):
                trie.add(term, tf, df)
    yield from emit()


def count_terms(rows: DataFrame) -> DataFrame:
    """Totals ``(term, tf, df)`` of rows ``(term, tf, df)`` without nulls, by burst-trie counting."""
    partial = cut_lineage(rows.select("term", F.col("tf").cast("bigint").alias("tf"), F.col("df").cast("bigint").alias("df")).mapInArrow(_count_partition, _PARTIAL))
    weights = partial.where("block is null").groupBy("prefix").agg(F.sum("terms").alias("terms"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = partial.where("block is not null").agg(F.sum("terms")).first()[0] or 0
    # At most 16 * tasks prefixes a level can hold this share, so the routing table has a fixed bound.
    heavy = frozenset(r["prefix"] for r in weights.where(F.col("terms") >= max(BLOCK // 4, total / (16 * tasks))).select("prefix").collect()) | {""}
    routed = partial.where("block is not null").select("prefix", "block").mapInArrow(_router(heavy), _ROUTED)
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merge_partition, _COUNTS)


def latest_rows(rows: DataFrame, group: str = "run_id") -> DataFrame:
    """Per (group, cleaned term) the row loaded last, as ``(group, term, tf, df)``; one shuffle."""
    term = F.lower(F.regexp_replace("term", r"(?U)^\s+|\s+$", ""))
    clean = rows.where("term is not null and tf is not null and df is not null").select(
        F.col(group), term.alias("term"), "tf", "df", F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("loaded_at")
    )
    return (
        clean.repartition(group, "term")
        .groupBy(group, "term", "loaded_at")
        .agg(F.max("tf").alias("tf"), F.max("df").alias("df"))
        .groupBy(group, "term")
        .agg(F.max_by("tf", "loaded_at").alias("tf"), F.max_by("df", "loaded_at").alias("df"))
    )


def term_frequencies(term_rows: DataFrame, analyze_runs: DataFrame, rare_df: int = 2, common_ratio: float = 0.4) -> DataFrame:
    """``(term, tf, df, df_ratio, mark)`` over all runs; mark is ``rare``, ``common`` or null, ``rare`` wins."""
    runs = analyze_runs.where("run_id is not null").groupBy("run_id").agg(F.max_by("n_docs", F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))).alias("n"))
    n_docs = runs.agg(F.sum("n")).first()[0] or 0
    mark = F.when(F.col("df") <= rare_df, "rare").when(F.col("df") > F.lit(common_ratio) * F.lit(n_docs), "common")
    counted = count_terms(latest_rows(term_rows))
    return counted.select("term", "tf", "df", (F.col("df") / F.lit(max(1, n_docs))).alias("df_ratio"), mark.alias("mark"))
