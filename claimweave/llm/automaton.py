"""Suffix automata of word sequences, and removal of spans found in a bounded reference.

A stated reference is cut into shards of at most ``SHARD_WORDS`` words; the automaton of each shard is
broadcast and every document is streamed through it.  At each word the automaton gives the longest
suffix read so far that occurs in the shard (the matching statistic); wherever that reaches the
threshold, the matched words are covered.  Overlapping covers join to maximal spans, which go.

A shard and its automaton have a fixed bound (about 0.4 KB a word), a worker holds one at a time, and
documents are never shuffled.  The work is shards times documents: right for a benchmark or a list of
boilerplate, not for comparing a corpus with itself (see ``substring``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, row_budget

MIN_WORDS = 50
SHARD_WORDS = 250_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class SuffixAutomaton:
    """Accepts every run of words of the sequences added; built online, one word at a time."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        """Add one sequence; runs never span two sequences."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is None:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p == -1:
                    last = new
                    continue
            else:
                new, p = None, last
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = twin
                    p = link[p]
                link[q] = twin
                if new is None:
                    new = twin
                else:
                    link[new] = twin
            last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each place the length of the longest run ending there that the automaton accepts."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            out.append(size)
        return out


def covered(matching: list[int], least: int, hit: bytearray) -> None:
    """Mark the words of every run of at least ``least`` matched words."""
    edge = len(matching)  # everything from here on is marked already
    for end in range(len(matching) - 1, -1, -1):
        if matching[end] >= least:
            start = end + 1 - matching[end]
            stop = min(end + 1, edge)
            if start < stop:
                hit[start:stop] = b"\1" * (stop - start)
            edge = min(edge, start)


def remove_reference_spans(docs: DataFrame, reference: DataFrame, least: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents without the runs of ``least`` words or more that occur in ``reference(text)``.

    A null text has no words; an empty reference removes nothing; repeated rows are treated alike.
    """
    spark = docs.sparkSession
    texts = reference.select("text").where(F.col("text").isNotNull())
    total = texts.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or 0
    n = row_budget(total, shard_words)
    shard = F.pmod(F.xxhash64("text"), F.lit(n))
    shared = [spark.sparkContext.broadcast([r.text.encode().split() for r in texts.where(shard == i).toLocalIterator()]) for i in range(n if total else 0)]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = None
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            hits = [bytearray(len(w)) for w in words]
            for part in shared:
                if built is None or len(shared) > 1:
                    built = SuffixAutomaton()
                    for sequence in part.value:
                        built.add(sequence)
                for w, hit in zip(words, hits, strict=True):
                    if len(w) >= least:
                        covered(built.matching(w), least, hit)
            kept = [b" ".join(x for x, gone in zip(w, h, strict=True) if not gone) for w, h in zip(words, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(h) for h in hits], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_batches(docs, ["doc_id", "text"], body, SCHEMA)
