"""How near a judge's reasoning is to a reference: figures, characters, vectors."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .figures import OVERLAP_MODES, reference_figures, score_overlap
from .text import collapse, last_break

# Thresholds.
EMBED_AT_LEAST = 0.60
TEXT_AT_LEAST = 0.12
REASONING_CHARS = 400

RECALL_MODES = (*OVERLAP_MODES, "reasoning_half", "reasoning_embed", "reasoning_sim", "hybrid")


def compare_form(value: Column) -> Column:
    """Lower case, punctuation other than ``% $ . ,`` to spaces, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(value), r"(?U)[^\w\s%$.,]", " "))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def text_similarity(reference: Column, reasoning: Column) -> Column:
    """Ratio of matching characters; the one measure here without a built-in."""
    return F.round(_ratio(compare_form(F.coalesce(reference, F.lit(""))), compare_form(last_break(F.coalesce(reasoning, F.lit("")), REASONING_CHARS))), 6)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def recall_hit(reference: Column, passages: Column, reasoning: Column, mode: str = "half_money", embedder=None) -> Column:
    """Whether the reference was found, by passage figures, by the reasoning, or by either.

    ``passages``: array of texts.  ``reasoning_embed`` and ``reasoning_sim`` need an embedder.
    """
    if mode not in RECALL_MODES:
        raise ValueError(f"unknown recall mode: {mode}")
    required = reference_figures(reference)
    found = F.array_distinct(F.flatten(F.transform(passages, reference_figures)))
    said = F.coalesce(reasoning, F.lit("")) != ""
    in_reasoning = said & score_overlap(required, reference_figures(reasoning), "half_money")["hit"]
    if mode in OVERLAP_MODES:
        return score_overlap(required, found, mode)["hit"]
    if mode == "reasoning_half":
        return in_reasoning
    if mode == "hybrid":
        return score_overlap(required, found, "half_money")["hit"] | in_reasoning
    near = said & (cosine(embedder.embed(collapse(reference)), embedder.embed(last_break(reasoning, REASONING_CHARS))) >= EMBED_AT_LEAST)
    if mode == "reasoning_embed":
        return near
    return near | in_reasoning | (said & (text_similarity(reference, reasoning) >= TEXT_AT_LEAST))
