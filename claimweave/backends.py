"""Model steps behind small interfaces, with deterministic local defaults.

The defaults make every plan runnable without a network.  They stand in for the interface and the
surrounding dataflow only; they do not reproduce a hosted model's judgments.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.figures import match_truth, reference_figures, truth_tokens
from .operators.retrieval import lexical_overlap


class Embedder(Protocol):
    dim: int

    def embed(self, text: Column) -> Column: ...


class HashedEmbedder:
    """Unit vectors of hashed token counts, in Arrow batches."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = []
                for t in texts:
                    at = [zlib.crc32(w.encode()) % dim for w in (t or "").lower().split()]
                    v = np.bincount(at, minlength=dim).astype(np.float32) if at else np.zeros(dim, np.float32)
                    out.append(v / max(1e-12, float(np.linalg.norm(v))))
                yield pd.Series(out)

        return vectors(text)


class Reranker(Protocol):
    def score(self, claim: Column, passage: Column) -> Column: ...


class OverlapReranker:
    """Share of the claim's tokens in the passage; stays inside generated code."""

    def score(self, claim: Column, passage: Column) -> Column:
        return lexical_overlap(claim, passage)


class Judge(Protocol):
    def judge(self, claim: Column, passages: Column) -> Column: ...


class FigureJudge:
    """Label by figures: all found: Consistent; the topic found but no figure: Contradictory; else Unverifiable.

    ``passages`` is an array of texts in rank order.  Returns the judgment struct.
    """

    def judge(self, claim: Column, passages: Column) -> Column:
        tokens = truth_tokens(claim)
        figures = F.filter(reference_figures(claim), lambda t: ~t.startswith("num:"))
        whole = F.array_join(passages, "\n")
        all_figures = match_truth(figures, whole)
        topic = match_truth(F.filter(tokens, lambda t: ~t.contains(":")), whole)
        rates = F.transform(passages, lambda p: match_truth(tokens, p)["rate"])
        best = F.when(F.size(passages) > 0, F.array_position(rates, F.array_max(rates)).cast("int")).otherwise(F.lit(0))
        label = (
            F.when((F.size(figures) > 0) & (all_figures["rate"] == 1.0), "Consistent")
            .when((F.size(figures) > 0) & (all_figures["rate"] == 0.0) & (topic["rate"] > 0.5), "Contradictory")
            .otherwise("Unverifiable")
        )
        reasoning = F.concat(F.lit("Passage "), best.cast("string"), F.lit(" holds "), F.array_join(match_truth(tokens, whole)["matched"], ", "))
        return F.struct(reasoning.alias("reasoning"), label.alias("classification"), F.round(topic["rate"], 6).alias("confidence_score"), best.alias("matched_passage_index"))


class SentenceExtractor:
    """Default claim extraction: sentences with a figure, in order, at most ``most`` for each call."""

    def __init__(self, most: int = 10):
        if not 1 <= most <= 15:
            raise ValueError("between 1 and 15 claims a call")
        self.most = most

    def extract(self, calls: DataFrame, keys: list[str], body: str = "text") -> DataFrame:
        # A bare F.trim would be given each element's index as the characters to trim.
        sentences = F.filter(F.transform(F.split(F.col(body), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s.rlike(r"[0-9]") & (F.length(s) >= 20))
        return calls.select(*keys, F.posexplode(F.slice(F.array_distinct(sentences), 1, self.most)).alias("pos", "claim"))


class RateLimited(Exception):
    """The provider asks to wait."""


class Transient(Exception):
    """The provider failed in a way that may pass."""


#: Waiting times and numbers of attempts.
RATE_LIMIT_WAIT, RATE_LIMIT_TRIES, TRANSIENT_WAIT, TRANSIENT_TRIES = 62.0, 8, 15.0, 5


def complete(prompt: str, models: list[str], call: Callable[[str, str], dict], sleep: Callable[[float], None] = time.sleep) -> tuple[dict, str]:
    """The first model that answers: each is retried while limited or failing, then the next has its turn."""
    last: Exception | None = None
    for model in models:
        left = {RateLimited: RATE_LIMIT_TRIES, Transient: TRANSIENT_TRIES}
        while True:
            try:
                return call(model, prompt), model
            except (RateLimited, Transient) as e:
                last = e
                left[type(e)] -= 1
                if left[type(e)] <= 0:
                    break
                sleep((RATE_LIMIT_WAIT if isinstance(e, RateLimited) else TRANSIENT_WAIT) + random.random())
    raise RuntimeError("no model answered") from last
