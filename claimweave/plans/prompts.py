"""Prompt texts as column expressions, for a hosted judge or extractor behind a backend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUDGE_RULES = (
    "Label the claim Consistent, Contradictory or Unverifiable from the passages alone. Units and ordinary rounding may differ. "
    "Contradictory needs a conflicting figure for the same metric and period. Answer with reasoning, label, confidence and passage number."
)
EXTRACT_RULES = "List the checkable financial claims of this call, one sentence each, with the speaker's name. At most {most} of them."
CORRUPT_RULES = "Change one figure of the claim beyond rounding and keep all other words."
UNSETTLED_RULES = "Rewrite the claim so that no filing could confirm or refute it."
REFERENCE_RULES = "Quote the words of the passages that settle the claim."


def passage_block(passages: Column) -> Column:
    """``passages``: array of structs with rank, section and text, in any order."""
    ordered = F.array_sort(F.transform(passages, lambda p: F.struct(p["rank"].alias("rank"), p["section"].alias("section"), p["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("Passage "), p["rank"].cast("string"), F.lit(" ["), F.coalesce(p["section"], F.lit("Unknown")), F.lit("]\n"), p["text"])), "\n\n")


def judge_prompt(claim: Column, passages: Column, suffix: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(JUDGE_RULES), F.concat(F.lit("Claim: "), claim), passage_block(passages), F.nullif(suffix, F.lit("")))


def extract_prompt(company: Column, transcript: Column, most: int = 10) -> Column:
    return F.concat_ws("\n\n", F.lit(EXTRACT_RULES.format(most=most)), F.concat(F.lit("Company: "), company), transcript)


def rewrite_prompt(claim: Column, rules: str) -> Column:
    return F.concat_ws("\n\n", F.lit(rules), F.concat(F.lit("Claim: "), claim))


def reference_prompt(claim: Column, passages: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(REFERENCE_RULES), F.concat(F.lit("Claim: "), claim), passage_block(passages))
