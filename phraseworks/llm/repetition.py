"""Repetition inside a document (problem 8).

Method: hashed n-gram log-likelihood ratio, per document, between two multinomials over the hashes of its runs of five
words: the raw text, in which a run counts as often as it stands there, and the trusted target, the text without its own
repetition, in which each run counts once. Normalised by length the ratio is ``llr = (1 / N) sum c ln(c / 1)`` over the
distinct runs, c their counts, N their sum. With D distinct runs the repeated share is ``s = 1 - D / N``; since c ln c is
convex, ``llr >= ln(N / D) = -ln(1 - s)``. So a document whose share reaches t has a ratio of at least ``-ln(1 - t)``: this
threshold decides, for every document and from the ratio alone, who can be a case, loses none, and on the corpus leaves
one document in forty. An exact check of the share follows, because one run repeated very often has a high ratio too.

Everything happens in one pass over the texts inside Arrow batches, with flat arrays (words and runs of a whole batch at
once); nothing is shuffled. ``multinomials`` gives the same two models of a whole corpus, in a fixed number of buckets.

Defined results: null and empty texts and texts below five words have share 0 and ratio 0; words are maximal runs of
letters and digits, lower-cased; texts of any length are measured whole; a document given in several rows (doc_id is
unique in the corpus) is measured row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseworks.llm.leakage import words_of

#: Hash buckets of the multinomials: the models have this many rows at most, whatever the corpus holds.
BUCKETS = 1 << 16
RUN = 5
#: Characters handled at a time; bounds the arrays.
PIECE = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered; forgotten when there are too many."""

    LIMIT = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Runs:
    """All runs of a piece of a batch: ``doc`` (index in the piece), ``hash``, and ``again`` (occurred earlier in its document)."""

    def __init__(self, texts: list[str | None], hashes: WordHashes, run: int = RUN):
        words = [words_of(t) for t in texts]
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(self.n.sum()))
        doc = np.repeat(np.arange(len(words)), self.n)
        self.counts = np.maximum(self.n - (run - 1), 0)
        if len(flat) >= run:
            h = np.zeros(len(flat) - run + 1, np.uint64)
            for k in range(run):
                h = (h ^ flat[k : len(flat) - run + 1 + k]) * _MIX
                h ^= h >> np.uint64(29)
            inside = doc[: len(h)] == doc[run - 1 :]
            self.hash, self.doc = h[inside], doc[: len(h)][inside]
        else:
            self.hash, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        order = np.lexsort((self.hash, self.doc))
        same = (np.diff(self.hash[order]) == 0) & (np.diff(self.doc[order]) == 0) if len(order) else np.zeros(0, bool)
        self.again = np.zeros(len(order), bool)
        self.again[order[1:][same]] = True
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
        #: Of each distinct run of a document: the document, and how often it stands there.
        self.owner, self.times = self.doc[order[first]], np.diff(np.append(first, len(order)))

    def ratio(self) -> np.ndarray:
        """Each document's log-likelihood ratio between raw and target multinomial, by its number of runs."""
        many = self.times > 1
        times = self.times[many].astype(np.float64)
        total = np.bincount(self.owner[many], times * np.log(times), minlength=len(self.counts))
        return total / np.maximum(self.counts, 1)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > PIECE:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


_COUNTS = "bucket int, raw bigint, target bigint"
_COUNTS_ARROW = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
_SCORES = "doc_id bigint, n_runs bigint, n_repeated bigint, llr double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("n_repeated", pa.int64()), ("llr", pa.float64())])


def multinomials(documents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target)``: how often runs of each bucket occur in the raw corpus and in the trusted target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in _pieces(texts):
                runs = Runs(texts[a:b], hashes)
                bucket = (runs.hash % np.uint64(buckets)).astype(np.int64)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[~runs.again], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], schema=_COUNTS_ARROW)

    counted = documents.select("text").where("text is not null").mapInArrow(count, _COUNTS)
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def scored(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, n_repeated, repeated_share, llr)`` of every document; one pass, no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in _pieces(texts):
                runs = Runs(texts[a:b], hashes)
                again = np.bincount(runs.doc[runs.again], minlength=b - a)
                columns = [ids[a:b], pa.array(runs.counts), pa.array(again.astype(np.int64)), pa.array(runs.ratio())]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCORES_ARROW)

    made = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, _SCORES)
    return made.select("doc_id", "n_runs", "n_repeated", (F.col("n_repeated") / F.greatest("n_runs", F.lit(1))).alias("repeated_share"), "llr")


def threshold(tenths: int) -> float:
    """The least ratio of a document with a repeated share of ``tenths`` / 10, less room for rounding."""
    return -math.log(1 - tenths / 10) - 1e-9


def repetitive(documents: DataFrame, tenths: int = 3) -> DataFrame:
    """Documents at or above the ratio's threshold whose exact repeated share is at least ``tenths`` / 10 (compared in whole numbers)."""
    cases = scored(documents).where(F.col("llr") >= threshold(tenths))
    return cases.where((F.col("n_repeated") * 10 >= F.col("n_runs") * tenths) & (F.col("n_runs") > 0))
