"""Choosing few rules that cover many documents."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HARD_CAP = 20
COVERAGE = 0.85


def mask_histogram(truths: DataFrame) -> DataFrame:
    """``(mask, n)``: how many documents match exactly these rules; all that selection needs to know of the documents."""
    return truths.groupBy("mask").agg(F.count("*").alias("n"))


def coverage(truths: DataFrame, n_rules: int) -> DataFrame:
    """``(rule_id, docs)`` for rules numbered from 1, zero where none matches."""
    counts = truths.agg(*[F.coalesce(F.sum(F.getbit("mask", F.lit(i)).cast("bigint")), F.lit(0).cast("bigint")).alias(str(i + 1)) for i in range(n_rules)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("rule_id"), F.col(f"`{i + 1}`").alias("docs")) for i in range(n_rules)])))


def penalties(rule_groups: DataFrame, stats: DataFrame) -> DataFrame:
    """``(rule_id, penalty)`` of ``(rule_id, groups array<array<string>>)``: too few or small groups and very common phrases cost."""
    small = F.aggregate("groups", F.lit(0.0), lambda acc, g: acc + F.when(F.size(g) < 2, 2.0).when(F.size(g) < 3, 1.0).otherwise(0.0))
    phrases = rule_groups.select("rule_id", F.explode(F.flatten("groups")).alias("term")).join(stats.select("term", "df_ratio"), "term")
    common = phrases.groupBy("rule_id").agg(F.sum(F.when(F.col("df_ratio") >= 0.85, 2.0).when(F.col("df_ratio") >= 0.70, 1.0).otherwise(0.0)).alias("common"))
    rows = rule_groups.select("rule_id", F.size("groups").alias("k"), small.alias("small")).join(common, "rule_id", "left")
    return rows.select("rule_id", F.when(F.col("k") < 2, 999.0).otherwise(F.col("small") + F.coalesce("common", F.lit(0.0))).alias("penalty"))


def penalty(groups: Sequence[Sequence[str]], df_ratio: Mapping[str, float]) -> float:
    if len(groups) < 2:
        return 999.0
    small = sum({0: 2.0, 1: 2.0, 2: 1.0}.get(len(g), 0.0) for g in groups)
    return small + sum(2.0 if r >= 0.85 else 1.0 if r >= 0.70 else 0.0 for g in groups for p in g if (r := df_ratio.get(p)) is not None)


def select_rules(histogram: Mapping[int, int], costs: Sequence[float], n_docs: int, base: int, target: float = COVERAGE, cap: int = HARD_CAP, same: Sequence[object] | None = None) -> list[int]:
    """Indices of the chosen rules, greedily by newly covered documents less cost, first of equals; exact, from masks alone.

    Stops when the best scored rule adds nothing, or the target is reached; then fills up to ``base`` in the given order,
    passing over rules equal (by ``same``) to a chosen one.
    """
    wanted = math.ceil(target * max(1, n_docs))
    chosen: list[int] = []
    left = list(range(len(costs)))
    taken = covered = 0
    while left and covered < wanted and len(chosen) < cap:
        gains = {i: sum(n for mask, n in histogram.items() if mask >> i & 1 and not mask & taken) for i in left}
        best = max(left, key=lambda i: gains[i] - costs[i])
        left.remove(best)
        if gains[best] <= 0:
            break
        chosen.append(best)
        taken |= 1 << best
        covered += gains[best]
    for i in range(len(costs)):
        if len(chosen) >= min(base, cap):
            break
        if i not in chosen and not (same and any(same[i] == same[j] for j in chosen)):
            chosen.append(i)
    return chosen
