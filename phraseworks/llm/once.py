"""Rows that were sent more than once, once each, without moving the texts of all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseworks.session import cut_lineage

#: Repeated keys that are replicated (8 bytes each); more of them are joined.
MAX_REPEATED = 1_000_000


def once(rows: DataFrame, key: str, at: str, limit: int | None = None) -> DataFrame:
    """``rows`` with one row per ``key``: that of the greatest ``at`` (null is least), then of the greatest hash of the whole row.

    Keys alone are counted first. Rows of keys that occur once stay where they are; only those of repeated keys, which are
    few, are shuffled with all their columns, pre-aggregated to one a task. Rows without a key stay. An empty table gives no rows.
    """
    repeated = cut_lineage(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key))
    few = repeated.count() <= (MAX_REPEATED if limit is None else limit)
    listed = F.broadcast(repeated) if few else repeated
    others = [c for c in rows.columns if c != key]
    order = F.struct(F.col(f"`{at}`"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))  # nulls are least in a struct
    sent = rows.join(listed, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), order).alias("__row")).select(key, "__row.*")
    return rows.join(listed, key, "left_anti").unionByName(sent.select(rows.columns))
