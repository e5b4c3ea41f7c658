"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good, votes bad or abstains.  Expectation
maximisation over all documents' votes estimates, for each rule, how often it votes either way on
good and on bad documents, together with the share of good ones; no label is read.  A document is
kept if its posterior probability of being good is at least ``KEEP``.  Fixed base rules (contract)
overrule that with a rejection.

Scale: one pass measures every text in Arrow batches (one row in, one row out, nothing shuffled).
Expectation maximisation needs only the counts of distinct vote patterns, of which there are at most
``3 ** len(RULES)`` however many documents there are; they are pre-aggregated by Spark.  The table of
posteriors has as many rows at most and is broadcast within that proven bound.

Edge cases: a null or wordless text has zero counts and fails the base rules; an empty table gives no
rows; repeated rows are judged one by one; a very long text is measured whole, in linear time; of two
equal lines the later counts as the copy; a posterior of exactly ``KEEP`` keeps; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches

KEEP = 0.5
MIN_WORDS = 50
ROUNDS = 100
MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string"

#: name, measure, good if (low, high) holds, bad if outside (low, high); between them the rule abstains.
RULES = [
    ("length", "words", (80, 50_000), (50, 200_000)),
    ("symbols", "symbols_per_word", (0, 0.02), (0, 0.1)),
    ("capitals", "capital_share", (0, 0.15), (0, 0.35)),
    ("letters", "letter_share", (0.72, 1), (0.6, 1)),
    ("windows", "repeat_share", (0, 0.1), (0, 0.4)),
    ("lines", "dup_line_share", (0, 0.1), (0, 0.35)),
    ("shouting", "marks_per_word", (0, 0.05), (0, 0.25)),
    ("word size", "word_size", (3, 8), (2.2, 14)),
    ("variety", "variety", (0.35, 1), (0.12, 1)),
    ("bare words", "symbol_words", (0, 0.05), (0, 0.25)),
]

_MARKS = b"#*$%&|<>"
_SYMBOLS = list(_MARKS)
_SPACES = [9, 10, 11, 12, 13, 32]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a ``size``-word window that occurs twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n].copy()
    for i in range(1, size):
        w = (w * _A) ^ (w >> np.uint64(31)) ^ (h[i : i + n] * _B)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(w, twice)
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + n] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[dict[str, float], tuple[int, ...]]:
    """The measures that rules look at, and the contract's five counts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    points = int(len(raw) - hist[128:192].sum())
    chars = points - int(hist[_SPACES].sum())
    symbols = int(hist[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    letters = int(hist[65:91].sum() + hist[97:123].sum() + hist[192:].sum())
    some = max(1, n)
    values = {
        "words": n,
        "symbols_per_word": symbols / some,
        "capital_share": float(hist[65:91].sum()) / max(1, letters),
        "letter_share": letters / max(1, points),
        "repeat_share": repeats / some,
        "dup_line_share": dup / max(1, len(lines)),
        "marks_per_word": float(hist[33] + hist[63]) / some,
        "word_size": chars / some,
        "variety": min(1.0, len(set(words)) / some * max(1.0, (n / 1000) ** 0.5)),
        "symbol_words": sum(not w.strip(_MARKS) for w in words) / some if symbols else 0.0,
    }
    return values, (n, chars, symbols, dup, repeats)


def vote(values: dict[str, float]) -> str:
    """One character a rule: ``+`` good, ``-`` bad, ``0`` abstains."""
    out = []
    for _, name, good, fair in RULES:
        v = values[name]
        out.append("+" if good[0] <= v <= good[1] else "0" if fair[0] <= v <= fair[1] else "-")
    return "".join(out)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def measured(docs: DataFrame) -> DataFrame:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column(1).to_pylist()]
            counts = [c for _, c in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)),
                pa.array([base_failed(c[0], c[4]) for c in counts], pa.bool_()),
                pa.array([vote(v) for v, _ in found], pa.string()),
            ], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes"])

    return map_batches(docs, ["doc_id", "text"], body, MEASURED)


def posteriors(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior probability of ``good`` for each vote pattern, by expectation maximisation.

    Starts from "no rule objects", so the two classes keep their meaning; every share is smoothed by
    one pseudo-document so that no single vote is taken as proof.
    """
    if not patterns:
        return {}
    patterns = sorted(patterns)
    votes = np.array([["+-0".index(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    onehot = np.eye(3)[votes]  # pattern, rule, vote
    good = np.where((votes == 1).any(1), 0.02, 0.98)
    for _ in range(rounds):
        share, log = [], []
        for part in (good, 1 - good):
            mass = part * weight
            table = np.einsum("p,prv->rv", mass, onehot) + 1 / 3
            table /= table.sum(1, keepdims=True)
            share.append((mass.sum() + 0.5) / (weight.sum() + 1))
            log.append(np.log(share[-1]) + np.einsum("prv,rv->p", onehot, np.log(table)))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return {p: float(g) for (p, _), g in zip(patterns, good, strict=True)}


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the contract's counts, base_failed, kept, and the posterior ``p_good``."""
    spark = docs.sparkSession
    rows = durable(measured(docs), "quality")  # read twice: for the votes' counts and for the result
    counted = [(r.votes, r["count"]) for r in rows.groupBy("votes").count().collect()]  # 3 ** len(RULES) rows at most
    table = spark.createDataFrame(list(posteriors(counted).items()), "votes string, p_good double")
    return (
        rows.join(F.broadcast(table), "votes", "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")
    )
