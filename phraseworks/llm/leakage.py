"""Evaluation passages inside a corpus (problem 6), by Wu-Manber multi-pattern search over words.

Patterns are all windows of ``run`` consecutive words of the held-out items. A block is two words. For each block that
occurs in a pattern the shift table holds how far the window may move on, all other blocks allow the longest shift, so
most of a document is skipped; a block of shift 0 ends a candidate, whose bucket (by the hash of the pattern's last block)
lists the patterns to compare directly, word by word. One pass over the corpus, no shuffle of texts.

Words are numbered, so tables hold numbers only: an item's words are one flat array, a bucket holds where its patterns
begin there. The pattern set is replicated to the tasks, its tables are built once per Python process. Its size is checked:
beyond ``max_pattern_words`` words of items the items are searched in groups of at most that many words, each in its own
pass over the corpus, so nothing that is replicated grows without bound. Items pass through the driver a group at a time.

Defined results: null and empty texts have no words; items below ``run`` words have no pattern and never leak; items with
the same passage are all reported; repeated pairs once; no items or no documents give no rows.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BLOCK = 2
RUN = 12
#: Words of held-out items that one pass replicates: 200,000 different ones took 43 MB in the tables of one process.
MAX_PATTERN_WORDS = 500_000


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower()) if text else []


class WuManber:
    """Shift table, suffix buckets and patterns of word windows, all by word numbers."""

    def __init__(self, items: Sequence[tuple[int, str]], run: int = RUN):
        self.run, self.longest = run, run - BLOCK + 1
        self.number: dict[str, int] = {}
        self.words = array("i")
        self.first, self.items = array("q"), array("q")  # where each item begins in words, and which it is
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, int | list[int]] = {}
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if len(own) < run:
                continue
            at = len(self.words)
            self.first.append(at)
            self.items.append(item)
            self.words.extend(own)
            blocks = [a << 32 | b for a, b in zip(own, own[1:], strict=False)]
            last = len(own) - run  # the last window begins here; block j ends at word j + 1
            for j, block in enumerate(blocks):
                # the nearest window end at or behind this block: its own end where a window can end there
                shift = max(0, run - 2 - j)
                if shift < self.shift.get(block, self.longest):
                    self.shift[block] = shift
            for start in range(last + 1):
                key = hash(tuple(own[start : start + run]))
                known = self.bucket.get(key)
                if known is None:
                    self.bucket[key] = at + start
                elif type(known) is int:
                    self.bucket[key] = [known, at + start]
                else:
                    known.append(at + start)

    def search(self, words: list[str]) -> set[int]:
        """The items of which ``words`` holds a pattern."""
        found: set[int] = set()
        shift, bucket, longest, run = self.shift, self.bucket, self.longest, self.run
        own = [*map(self.number.get, words, repeat(-1))]
        i, n = run - 1, len(own)
        while i < n:
            a, b = own[i - 1], own[i]
            step = longest + 1 if b < 0 else longest if a < 0 else shift.get(a << 32 | b, longest)
            if step:
                i += step
                continue
            window = own[i - run + 1 : i + 1]
            starts = bucket.get(hash(tuple(window)))
            if starts is not None:
                for at in (starts,) if type(starts) is int else starts:
                    if self.words[at : at + run].tolist() == window:
                        found.add(self.items[bisect_right(self.first, at) - 1])
            i += 1
        return found


#: Tables built in this process, of the group last searched for.
_built: dict[int, WuManber] = {}


def tables(key: int, group: Sequence[tuple[int, str]], run: int) -> WuManber:
    if key not in _built:
        _built.clear()
        _built[key] = WuManber(group, run)
    return _built[key]


#: Python workers outlive a query but not the session of their driver, so a running number names a group.
_keys = count()

_FOUND = "doc_id bigint, item_id bigint"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def _groups(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    group: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator():
        n = len(words_of(r["text"]))
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append((r["item_id"], r["text"]))
        size += n
    if group:
        yield group


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN, max_pattern_words: int = MAX_PATTERN_WORDS) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds at least ``run`` consecutive words of an item."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    passes = []
    for group in _groups(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null and item_id is not null"), max_pattern_words):
        shared = spark.sparkContext.broadcast(group)
        key = next(_keys)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            patterns = tables(key, shared.value, run)
            for batch in batches:
                docs, found = [], []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    for item in patterns.search(words_of(text)):
                        docs.append(doc)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], schema=_FOUND_ARROW)

        passes.append(texts.mapInArrow(search, _FOUND))
    if not passes:
        return spark.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionAll, passes).distinct()
