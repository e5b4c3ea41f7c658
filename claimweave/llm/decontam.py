"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters/digits and of any non-ASCII character, A-Z lower-cased.  Of every
stretch of ``WINDOW - K + 1`` consecutive word k-grams the smallest hash is kept (the rightmost at a
tie).  Two texts that share ``WINDOW`` consecutive words hold one common stretch and therefore keep
one common fingerprint, so meeting the benchmark's fingerprints loses no shared window.  Every met
fingerprint is extended to the windows around it, and those are joined with the benchmark's windows by
their words, so only true hits count.  Items of fewer than ``WINDOW`` words are one window of their own
length and meet by its hash.

Scale: one path for every size of the benchmark, and neither table passes through the driver.  The
benchmark's fingerprints become a Bloom filter of ``FILTER_BITS`` bits, or'ed together by Spark; that
filter, of a fixed 4 MB, is all that is broadcast.  A fuller filter lets more windows through to the join,
which decides; it never loses one.  Documents are read once; only windows that pass the filter leave the
Python workers, once for each distinct text (by MD5), and are joined with the benchmark's windows in
exchanges that Spark may split where one passage is frequent.

Edge cases: a null or wordless text has no words, no hits and is clean; null or wordless items never
occur; repeated items count once per ``item_id``, a null id counts as the empty one; repeated documents
are judged one by one; very long texts are judged whole, their hit places being the only thing held;
ties of hashes keep the rightmost; empty tables give no rows or clean rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free, join_apart, map_batches

WINDOW = 8
K = 5
MIN_ITEMS = 2
FILTER_BITS = 1 << 25
#: Distinct words whose hashes a worker remembers.
MEMO = 500_000
KEY = "__text_key"
#: Texts to drop, of 32 bytes each, that are broadcast at most; more of them meet the documents in a shuffle.
BROADCAST_KEYS = 250_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HITS = "array<struct<win:binary,size:int,at:array<int>>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = _Hashes()


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` word hashes; runs of different lengths differ too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: in every ``width`` consecutive hashes the smallest, the rightmost at a tie."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = hashes[:n].copy()
    at = np.arange(n)
    for i in range(1, width):
        cand = hashes[i : i + n]
        take = cand <= best
        best[take] = cand[take]
        at[take] = np.nonzero(take)[0] + i
    return np.unique(at)


def _places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the filter for each fingerprint."""
    return (prints % np.uint64(bits)).astype(np.int64), ((prints >> np.uint64(32)) * _MIX % np.uint64(bits)).astype(np.int64)


def _passes(grams: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    one, two = _places(grams, 8 * len(bloom))
    return (bloom[one >> 3] >> (one & 7) & bloom[two >> 3] >> (two & 7) & 1).astype(bool)


def _item_prints(words: list[bytes], window: int, k: int) -> np.ndarray:
    h = _HASHES.of(words)
    if len(words) < window:
        return kgram_hashes(h, len(words)) if words else np.empty(0, np.uint64)
    grams = kgram_hashes(h, k)
    return grams[winnow(grams, window - k + 1)]


def _bloom(benchmark: DataFrame, window: int, k: int, bits: int) -> np.ndarray:
    """The filter of all fingerprints and short windows; at most ``bits / 64`` words reach the driver."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_item_prints(words_of(t), window, k) for t in batch.column(0).to_pylist()]
            places = np.unique(np.concatenate([p for x in prints for p in _places(x, bits)] or [np.empty(0, np.int64)]))
            word, first = np.unique(places >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first) if len(word) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    rows = map_batches(benchmark, ["text"], body, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (win, size, item): the windows of all items, words joined by one space."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wins, sizes, items = [], [], []
            for item, text in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                some = {b" ".join(words[s : s + size]) for s in range(len(words) - size + 1)} if size else set()
                wins += some
                sizes += [size] * len(some)
                items += [item] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array(sizes, pa.int32()), pa.array(items, pa.string())], ["win", "size", "item"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    return durable(map_batches(rows, ["item", "text"], body, "win binary, size int, item string").distinct(), "benchmark")


def candidates(words: list[bytes], bloom: np.ndarray, short: list[int], window: int, k: int) -> list[dict]:
    """Windows of one text that the filter lets through, each with all its places."""
    h = _HASHES.of(words)
    found: list[tuple[int, np.ndarray]] = []
    if len(h) >= window:
        width = window - k + 1
        grams = kgram_hashes(h, k)
        kept = winnow(grams, width)
        kept = kept[_passes(grams[kept], bloom)]
        if len(kept):
            starts = np.unique((kept[:, None] - np.arange(width)[None, :]).ravel())
            found.append((window, starts[(starts >= 0) & (starts <= len(h) - window)]))
    found += [(size, np.nonzero(_passes(kgram_hashes(h, size), bloom))[0]) for size in short]
    at: dict[tuple[int, bytes], list[int]] = {}
    for size, starts in found:
        for s in starts.tolist():
            at.setdefault((size, b" ".join(words[s : s + size])), []).append(s)
    return [{"win": win, "size": size, "at": places} for (size, win), places in at.items()]


def _seen(docs: DataFrame, benchmark: DataFrame, windows: DataFrame, window: int, k: int, bits: int, all_rows: bool) -> DataFrame:
    """Per row: doc_id, text key, number of words, candidate windows; without ``all_rows`` only rows that have some."""
    short = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # under ``window`` values
    shared = docs.sparkSession.sparkContext.broadcast((_bloom(benchmark, window, k, bits), short))  # ``bits / 8`` bytes

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, sizes = shared.value
        for batch in (b.slice(s, 512) for b in batches for s in range(0, b.num_rows, 512)):
            counts, hits = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                hits.append(candidates(words, bloom, sizes, window, k) if words else [])
            kind = pa.list_(pa.struct([("win", pa.binary()), ("size", pa.int32()), ("at", pa.list_(pa.int32()))]))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(hits, kind)], ["doc_id", "key", "n_words", "hits"])
            yield out if all_rows else out.filter(pa.array([bool(x) for x in hits], pa.bool_()))

    keyed = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("key"))
    return durable(map_batches(keyed, ["doc_id", "text", "key"], body, f"doc_id long, key string, n_words long, hits {_HITS}"), "candidates")


def _distinct_hits(seen: DataFrame) -> DataFrame:
    """(key, win, size, at) of every distinct text."""
    once = seen.where(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits"))
    return once.select("key", F.explode("hits").alias("h")).select("key", "h.*")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, min_items: int = MIN_ITEMS, bits: int = FILTER_BITS) -> DataFrame:
    """Per document: words, hit words, occurring items, digest of their ids, contaminated or not."""
    windows = _windows(benchmark, window)
    seen = _seen(docs, benchmark, windows, window, k, bits, all_rows=True)
    hits = _distinct_hits(seen)
    covered = F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("at", lambda s: F.sequence(s, s + F.col("size") - 1))))))
    words = join_apart(hits, windows.select("win").distinct(), "win", "left_semi").groupBy("key").agg(F.size(covered).cast("long").alias("n_hit"))
    items = hits.select("key", "win").join(windows.select("win", "item"), "win").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return join_apart(seen.drop("hits"), words.join(items, "key"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.greatest(F.size("items"), F.lit(0)) >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without the documents that hold any window of any item, all columns kept."""
    name = free(KEY, docs.columns)
    windows = _windows(benchmark, window)
    hits = _distinct_hits(_seen(docs, benchmark, windows, window, k, bits, all_rows=False))
    gone = join_apart(hits.select("key", "win"), windows.select("win").distinct(), "win", "left_semi").select(F.col("key").alias(name)).distinct()
    gone = durable(gone, "contaminated")
    keyed = docs.withColumn(name, F.md5(F.col("text").cast("binary")))
    if gone.count() <= BROADCAST_KEYS:
        return keyed.join(F.broadcast(gone), name, "left_anti").drop(name)
    return join_apart(keyed, gone, name, "left_anti").drop(name)
