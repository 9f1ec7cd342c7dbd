"""Mixing sources to target weights (problem 7), by entropy balancing.

Document rates stay as near as possible (in relative entropy) to one copy each while every source's tokens meet its target
and no rate exceeds the source's cap. The convex dual has one multiplier per source; its solution tilts rates exponentially,
``rate = min(cap, exp(multiplier * tokens / mean tokens))``. Newton steps for all multipliers at once are sums over the
corpus, worked out by Spark from counts per (source, tokens), bracketed so that each step stays inside what earlier ones
ruled out; that it has not converged is an error. Rates are rounded to whole copies systematically: documents are put into
blocks by a hash of their id, in a block in the order of their size, and a document gets one copy more wherever the running
sum of the fractions passes a whole number. Running sums go on from block to block, so each source's copies are exact to
one and its tokens nearly so, no task holds more than a block, the result does not depend on partitioning, and no copy
count exceeds the cap.

The size of the mix is, unless given, the largest at which every target can be met within the caps; a greater one is an
error. Targets of sources that have no tokens are shared among the others in proportion, and reported.

Defined results: source spellings are compared trimmed, lower-cased, with blanks and hyphens as underscores; documents
without tokens or source, or of a source without target, get no copies; a source given twice in the targets has the sum of
its shares and the least cap; null or negative shares count as 0, null caps as 1; empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseworks.session import cut_lineage

MAX_STEPS = 60
#: Documents of a block of the rounding, on the average.
BLOCK = 8192
#: Parts that a copy's fraction is counted in: whole numbers, so sums do not depend on their order.
PARTS = 1 << 32
TOLERANCE = 1e-9


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, source, tokens)``: every document's size in tokens of a public tokenizer, whole texts."""
    import public_tokenizers

    path, pattern = tokenizer or default_tokenizer(), public_tokenizers.PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(sizes, pa.int64())], schema=_TOKENS_ARROW)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


class Target:
    """One source's state of the dual: wanted tokens, cap, mean size, and the bracket of its multiplier."""

    def __init__(self, wanted: float, cap: int, mean: float, n: int):
        self.wanted, self.cap, self.mean, self.n = wanted, cap, mean, n
        self.at, self.low, self.high, self.done = 0.0, -math.inf, math.inf, False

    def step(self, got: float, slope: float) -> None:
        if abs(got - self.wanted) <= TOLERANCE * max(self.wanted, 1.0):
            self.done = True
            return
        if got < self.wanted:
            self.low = self.at
        else:
            self.high = self.at
        to = self.at + (self.wanted - got) / slope if slope > 0 else math.inf if got < self.wanted else -math.inf
        to = min(max(to, self.at - 2.0), self.at + 2.0)
        if not self.low < to < self.high:
            to = (self.low + self.high) / 2
        self.done = abs(to - self.at) < 1e-13 * max(1.0, abs(self.at))
        self.at = to


def _by_source(values: dict[str, float]) -> Column:
    """A literal map from source to number: as long as the targets table."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("source")]


def _rate(targets: dict[str, Target]) -> Column:
    exponent = _by_source({s: t.at / t.mean for s, t in targets.items()}) * F.col("tokens")
    cap = _by_source({s: float(t.cap) for s, t in targets.items()})
    return F.least(cap, F.exp(F.least(exponent, F.lit(50.0))))


def balance(counted: DataFrame, mix_targets: DataFrame, size: float | None = None) -> tuple[dict[str, Target], dict[str, float]]:
    """The solved multipliers of the sources that have tokens, and the given shares."""
    given = mix_targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap")
    ).collect()
    shares = {r["source"]: r["share"] for r in given}
    histogram = cut_lineage(counted.where("tokens > 0 and source is not null").groupBy("source", "tokens").agg(F.count("*").alias("n")))
    held = {r["source"]: r for r in histogram.where(F.col("source").isin([*shares])).groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("tokens")).collect()}
    usable = {r["source"]: r for r in given if r["share"] > 0 and r["cap"] > 0 and r["source"] in held}
    total_share = sum(r["share"] for r in usable.values())
    reachable = min((r["cap"] * held[s]["tokens"] * total_share / r["share"] for s, r in usable.items()), default=0.0)
    if size is not None and usable and size > reachable * (1 + 1e-9):
        raise ValueError(f"a mix of {size:.0f} tokens needs more than the caps allow: {reachable:.0f} at most")
    total = reachable if size is None else size
    targets = {s: Target(total * r["share"] / total_share, r["cap"], held[s]["tokens"] / held[s]["n"], held[s]["n"]) for s, r in usable.items()}
    for s, t in targets.items():
        if t.wanted >= t.cap * held[s]["tokens"] * (1 - 1e-9):  # all copies the cap allows
            t.at, t.done = 1e9 * t.mean, True
    for _ in range(MAX_STEPS):
        open_ = {s: t for s, t in targets.items() if not t.done}
        if not open_:
            break
        sizes = F.col("n") * F.col("tokens") * F.col("rate")
        slope = sizes * F.col("tokens") / _by_source({s: t.mean for s, t in open_.items()})
        rated = histogram.where(F.col("source").isin([*open_])).withColumn("rate", _rate(open_)).withColumn("cap", _by_source({s: float(t.cap) for s, t in open_.items()}))
        for r in rated.groupBy("source").agg(F.sum(sizes).alias("got"), F.sum(F.when(F.col("rate") < F.col("cap"), slope).otherwise(0.0)).alias("slope")).collect():
            open_[r["source"]].step(r["got"], r["slope"])
    if late := [s for s, t in targets.items() if not t.done]:
        raise RuntimeError(f"not converged within {MAX_STEPS} steps: {late}")
    return targets, shares


def rounded(rated: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """``rated (doc_id, source, tokens, rate)`` with ``copies``; sizes are the documents of each source."""
    order = F.xxhash64("doc_id", F.lit(seed))
    block = F.pmod(order, _by_source({s: max(1, n // BLOCK) for s, n in sizes.items()}))
    placed = rated.select("*", F.floor("rate").alias("whole"), F.floor((F.col("rate") - F.floor("rate")) * PARTS).alias("part"), order.alias("order"), block.alias("block"))
    totals = placed.groupBy("source", "block").agg(F.sum("part").alias("total"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    begun = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(PARTS))
    starts = totals.select("source", "block", (begun + F.coalesce(F.sum("total").over(before), F.lit(0))).alias("start"))
    within = Window.partitionBy("source", "block").orderBy("tokens", "order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("sum", F.sum("part").over(within)).join(starts, ["source", "block"])
    end = F.col("start") + F.col("sum")
    more = F.shiftright(end, 32) - F.shiftright(end - F.col("part"), 32)
    return summed.select("doc_id", "source", "tokens", "rate", (F.col("whole") + more).cast("int").alias("copies"))


def mixed(documents: DataFrame, mix_targets: DataFrame, size: float | None = None, tokenizer: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(selection, shares)``: ``(doc_id, source, tokens, rate, copies)`` of every document with a source in the targets, and per source

    ``(source, target_share, n_docs, tokens, mixed_tokens, actual_share, most_copies)``, sources without target or tokens included.
    """
    counted = cut_lineage(token_counts(documents, tokenizer))
    targets, shares = balance(counted, mix_targets, size)
    spark = documents.sparkSession
    if targets:
        usable = counted.where(F.col("source").isin([*targets]) & (F.col("tokens") > 0))
        selection = rounded(usable.withColumn("rate", _rate(targets)), {s: t.n for s, t in targets.items()}, seed)
    else:
        selection = counted.where("false").select("*", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    taken = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    sums = {r["source"]: r for r in taken.collect()}  # one row a targeted source
    total = sum(r["mixed_tokens"] for r in sums.values())
    held = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    named = spark.createDataFrame([(s, float(x), int(sums[s]["mixed_tokens"]) if s in sums else 0, int(sums[s]["most_copies"]) if s in sums else 0) for s, x in shares.items()], "source string, target_share double, mixed_tokens bigint, most_copies int")
    both = held.join(named, "source", "full")
    zero = F.lit(0).cast("bigint")
    report = both.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), (F.coalesce("mixed_tokens", zero) / F.lit(float(max(total, 1)))).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return selection, report
