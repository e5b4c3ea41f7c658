"""Substring dedup of a corpus against itself: words of a 50-word run that an earlier document has too.

The named method, broadcast suffix automata of reference shards, is in ``automaton``; comparing a corpus
with itself that way costs shards times documents, quadratic in the corpus (figures in the README).
Here the same spans are found in linear work:

1. Anchors.  Every 50-word window keeps a winnowed k-gram, chosen by content alone, so a window that
   two documents share leaves a common anchor in both.
2. Equal texts fold to their smallest id; anchors held by one text only are dropped.
3. Documents with a remaining anchor emit the hashes of exactly the windows around those anchors; the
   smallest document of every window is a pre-aggregated minimum.  A window whose smallest document is
   smaller than its own is removed; overlapping windows join to maximal spans.
4. The spans are joined to the texts, and every document comes out with its kept text and removed spans.

Scale: hashes are aggregated with map-side combining and joined to one row per key, so a passage that a
third of all documents holds is a skewed side that AQE may split, never a group in one task.  Rows meet
their spans by id and text hash together, so rows without an id, or with one id, are no hot key.  Texts move
once for the cut, those that share something once more before; no pairs of documents are ever formed.
Every step is written and what it read is deleted, so the disk holds one step at a time.
Windows are told apart by 96 bits of two seeds and not compared word for word: over 10^13 windows the
expected number of false matches is under 0.001.  Two texts of one id are told apart by 64 bits.

Edge cases: a null text has no words; a document without id counts as the largest and is never
"smaller"; rows sharing an id are not smaller than each other, and repeated rows lose the same words; a text
of fewer than 50 words loses nothing; a very long text is judged whole; of equal texts all but the
smallest id go whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, finished, map_batches

WINDOW = 50
K = 12
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words, repeat(seed)), np.uint64, len(words))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words, by doubling a polynomial."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(h) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
                done += size
        if 2 * size > k:
            break
        n = len(part) - size
        part = part[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size : size + n]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each stretch of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors_of(h: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): each k-gram that is the smallest in some stretch of ``window - k + 1``."""
    width = window - k + 1
    grams = run_hashes(h, k)
    if len(grams) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _slide(grams, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.nonzero(_slide(around, width, np.maximum) == grams)[0]
    return at, grams[at]


def _base(docs: DataFrame) -> DataFrame:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            shas = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(w) for w in words], pa.int64()), pa.array(shas, pa.binary())], ["id", "raw", "n_words", "sha"])

    return map_batches(docs, ["id", "text", "raw"], body, "id long, raw long, n_words long, sha binary")


def _anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, places, hashes = [], [], [], []
            for doc, text, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                at, h = anchors_of(word_hashes(words), window, k)
                ids.append(np.full(len(at), doc, np.int64))
                raws.append(np.full(len(at), raw, np.int64))
                places.append(at.astype(np.int32))
                hashes.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (hashes, ids, raws, places)], ["a", "id", "raw", "pos"])

    return map_batches(docs, ["id", "text", "raw"], body, "a long, id long, raw long, pos int")


def _starts(places: np.ndarray, n_words: int, window: int, k: int) -> np.ndarray:
    """Starts of the windows that hold one of the k-grams at ``places``."""
    flag = np.zeros(n_words + 1, np.int64)
    np.add.at(flag, np.maximum(0, places - (window - k)), 1)
    np.add.at(flag, np.minimum(places, n_words - window) + 1, -1)
    return np.nonzero(np.cumsum(flag[: n_words - window + 1]) > 0)[0]


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of every window: 64 and 32 from two seeds of the word hash."""
    return run_hashes(word_hashes(words), window), (run_hashes(word_hashes(words, 1), window) >> np.uint64(32)).astype(np.uint32)


def _windows(shared: DataFrame, window: int, k: int) -> DataFrame:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw, text, places in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = words_of(text)
                at = _starts(np.array(places, np.int64), len(words), window, k)
                one, two = window_hashes(words, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int32)), pa.array(np.full(len(at), doc, np.int64)), pa.array(np.full(len(at), raw, np.int64)), pa.array(at.astype(np.int32))],
                    ["w", "v", "id", "raw", "pos"],
                )

    return map_batches(shared, ["id", "raw", "text", "places"], body, "w long, v int, id long, raw long, pos int")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Removed spans and kept text of every row, by the starts of its removed windows or ``whole``."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            n_words, n_removed, spans, texts = [], [], [], []
            for text, whole, starts in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                words = words_of(text)
                found = [(0, len(words))] if whole else _joined(np.unique(np.array(starts or [], np.int64)), window)
                kept, at = [], 0
                for a, b in found:
                    kept += words[at:a]
                    at = b
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in found))
                spans.append([{"start": a, "end": b} for a, b in found])
                texts.append(b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass"))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string()),
            ], ["id", "n_words", "n_removed", "removed", "kept_text"])

    return map_batches(rows, ["id", "text", "whole", "starts"], body, "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")


def _joined(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal spans of the windows at sorted ``starts``."""
    if not len(starts):
        return []
    edges = np.nonzero(np.diff(starts) > window)[0]
    first, last = starts[np.append(0, edges + 1)], starts[np.append(edges, len(starts) - 1)]
    return list(zip(first.tolist(), (last + window).tolist(), strict=True))


def _join_apart(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``common.join_apart`` with a further key that is always 0, so that it costs next to nothing in the exchange."""
    apart = F.xxhash64(keys[0]).bitwiseAND(F.lit(0)).alias("apart")
    return rows.select("*", apart).join(summary.select("*", apart), [*keys, "apart"], how).drop("apart")


def cut_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removed (word positions, end exclusive) and kept_text.

    ``kept_text`` holds the kept words with single spaces between them; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text", F.xxhash64("text").alias("raw"))
    base = durable(_base(rows), "texts")
    first = base.groupBy("sha").agg(F.min("id").alias("first_id"))
    copies = _join_apart(base, first, ["sha"]).where(F.col("id") > F.col("first_id")).select("id", "raw", "n_words").distinct()

    anchors = durable(_anchors(rows, window, k), "anchors")
    common = anchors.groupBy("a").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("a")
    places = durable(
        _join_apart(anchors, common, ["a"], "left_semi")
        .groupBy("id", "raw").agg(F.collect_set("pos").alias("places"))  # no longer than the document
        .join(copies.select("id", "raw"), ["id", "raw"], "left_anti"),
        "places",
    )
    places = finished(places, anchors)
    shared = _join_apart(rows, places, ["id", "raw"]).select("id", "raw", "text", "places")
    windows = finished(durable(_windows(shared, window, k), "windows"), places)
    earliest = windows.groupBy("w", "v").agg(F.min("id").alias("least"))
    some = durable(
        _join_apart(windows, earliest, ["w", "v"]).where(F.col("least") < F.col("id"))
        .groupBy("id", "raw").agg(F.collect_set("pos").alias("starts"))
        .select("id", "raw", F.lit(False).alias("whole"), "starts"),
        "spans",
    )
    some = finished(some, windows)
    whole = copies.where(F.col("n_words") >= window).select("id", "raw", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    # Copies have no windows, so a row is in one of the two at most.
    cut = _cut(_join_apart(rows, some.unionByName(whole), ["id", "raw"], "left"), window)
    return cut.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "removed", "kept_text")


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Digest of ``cut_repeats``: doc_id, n_words, n_removed, kept_sha256."""
    return cut_repeats(docs, window, k).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
