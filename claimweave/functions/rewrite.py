"""Rewriting of claims into retrieval queries, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import quarter_label
from .numbers import general, let
from .text import collapse

# The wording that the rules look for.
AMOUNT = r"(?iU)(\$?\d+(?:\.\d+)?\s*(?:b(?!\w)|billions?+(?:\s+dollars?+)?+))"
EXPANDED = r"(?iU)^\s*\(\s*\d+(?:\.\d+)?\s+million\s*\)"
HAS_FIGURE = r"(?iU)\$|\d+(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?\s*%|\d+(?:\.\d+)?\s*(?:million|billion|[MB])\b"
REVENUE = r"(?iU)\b(revenues?)\b(?!\s*\(\s*net sales\s*\))"
Q4_WORDS = r"(?iU)\b(?:fourth[\s\-]+quarter|4th[\s\-]+quarter|final[\s\-]+quarter|q4|\w+\s+quarter)\b"
YEAR_WORDS = r"(?iU)\b(?:full[\s\-]+year|fiscal[\s\-]+year|annual|trailing[\s\-]+(?:twelve|12)[\s\-]+months?|fy20\d{2}|fy\d{2})\b"
YEAR_PHRASE = "12 month (year ended) period"
NINE_MONTH_PHRASE = "nine months ended period"

STANDARD, YEAR_ONLY, COMPOSITE = "STANDARD_QUARTER", "FULL_YEAR_ONLY", "Q4_COMPOSITE"


def expand_billions(query: Column) -> Column:
    """`` (N million)`` after every amount in billions that has none yet."""
    def piece(hit: Column, i: Column, rest: Column) -> Column:
        after = F.element_at(rest, i + 2)
        thousands = F.regexp_extract(hit, r"(\d+(?:\.\d+)?)", 1).try_cast("double") * 1000
        suffix = let(thousands, lambda v: F.concat(F.lit(" ("), F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(general(v)), F.lit(" million)")))
        return F.concat(hit, F.when(after.rlike(EXPANDED), F.lit("")).otherwise(suffix), after)

    def joined(parts: Column) -> Column:
        return F.concat(parts["rest"][0], F.array_join(F.transform(parts["hits"], lambda hit, i: piece(hit, i, parts["rest"])), ""))

    return let(F.struct(F.regexp_extract_all(query, F.lit(AMOUNT), 1).alias("hits"), F.split(query, AMOUNT, -1).alias("rest")), joined)


def expand_revenue(query: Column) -> Column:
    """``revenue`` also as ``net sales``, only in a claim with a figure."""
    return F.when(query.rlike(HAS_FIGURE), F.regexp_replace(query, REVENUE, "$1 (net sales)")).otherwise(query)


def expand_units(query: Column) -> Column:
    return let(expand_billions(query), expand_revenue)


def temporal_scope(text: Column, fiscal_quarter: Column) -> Column:
    """Which filings a claim needs; a value that is no quarter counts as an ordinary quarter."""
    is_q4 = F.coalesce(quarter_label(fiscal_quarter) == "Q4", F.lit(False))
    return F.when(~is_q4, STANDARD).when(text.rlike(Q4_WORDS), COMPOSITE).when(text.rlike(YEAR_WORDS), YEAR_ONLY).otherwise(COMPOSITE)


def _period_as(query: Column, phrase: str) -> Column:
    return let(query, lambda q: let(F.regexp_replace(q, Q4_WORDS, phrase), lambda s: collapse(F.when(s == q, F.concat(F.lit(f"for {phrase} "), q)).otherwise(s))))


def annual_query(query: Column) -> Column:
    return _period_as(query, YEAR_PHRASE)


def nine_month_query(query: Column) -> Column:
    return _period_as(query, NINE_MONTH_PHRASE)


def required_doc_types(scope: Column) -> Column:
    return (
        F.when(scope == YEAR_ONLY, F.array(F.lit("10-K")))
        .when(scope == COMPOSITE, F.array(F.lit("10-K"), F.lit("10-Q")))
        .otherwise(F.array(F.lit("10-Q")))
    )


def query_plan(claim: Column, fiscal_quarter: Column) -> Column:
    """Struct of the rewritten query, its scope, the document types and the extra instruction, if any."""
    scope = temporal_scope(claim, fiscal_quarter)
    suffix = F.when(scope == COMPOSITE, F.lit("Derive Q4 as the 12-month figure less the nine-month figure before comparing.")).otherwise(F.lit(""))
    return F.struct(
        expand_units(claim).alias("processed_query"), scope.alias("temporal_scope"),
        required_doc_types(scope).alias("required_doc_types"), suffix.alias("nli_instruction_suffix"),
    )


def path_log(scope: Column) -> Column:
    return F.when(scope == COMPOSITE, "10-K/FY + 10-Q/Q3").when(scope == YEAR_ONLY, "10-K/FY").otherwise("10-Q")
