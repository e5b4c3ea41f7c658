"""Figures in text: normalised tokens, overlap rules, truth tokens and passage references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed, general, let
from .text import keywords

# Forms of a figure, and thresholds.
FIGURE = r"(?iU)(\$?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:b(?!\w)|m(?!\w)|billions?|millions?|%)?)"
PERCENT = r"(?U)(?<!\d)(\d+(?:\.\d+)?)\s*%"
HIT_ABOVE = 0.5
HALF_MONEY = 0.5

OVERLAP_MODES = ("strict", "ignore_num", "any_money", "half_money")


def _figure_token(match: Column) -> Column:
    number = F.replace(F.regexp_extract(match, r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")

    def named(x: Column) -> Column:
        low, value, shown = x["low"], x["value"], x["shown"]
        money = F.concat(F.lit("usd_m:"), shown)
        return (
            F.when(low.endswith("%"), F.concat(F.lit("pct:"), shown))
            .when(low.rlike("b$|billions?$"), F.concat(F.lit("usd_m:"), general(value * 1_000_000)))  # scaled twice, kept so
            .when(low.startswith("$") | low.rlike("m$|millions?$"), money)
            .when(F.length(F.substring_index(shown, ".", 1)) == 4, F.lit(None).cast("string"))  # looks like a year
            .when(value >= 100, money)
            .otherwise(F.concat(F.lit("num:"), shown))
        )

    return let(number, lambda v: let(F.struct(F.trim(F.lower(match)).alias("low"), v.alias("value"), general(v).alias("shown")), named))


def reference_figures(text: Column) -> Column:
    """Sorted distinct tokens ``pct:``, ``usd_m:`` and ``num:`` of the figures in a text."""
    return let(F.coalesce(text, F.lit("")), _figures)


def _figures(text: Column) -> Column:
    figures = F.transform(F.regexp_extract_all(text, F.lit(FIGURE), 1), _figure_token)
    percents = F.transform(F.regexp_extract_all(text, F.lit(PERCENT), 1), lambda n: F.concat(F.lit("pct:"), general(n.try_cast("double"))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(figures, percents))))


def _money(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.startswith("num:"))


def score_overlap(required: Column, found: Column, mode: str = "strict") -> Column:
    """Struct (hit, matched, missing) of the required tokens among those found, in the required order."""
    if mode not in OVERLAP_MODES:
        raise ValueError(f"unknown overlap mode: {mode}")
    found = F.coalesce(found, F.array().cast("array<string>"))

    def scored(wanted: Column) -> Column:
        return let(F.filter(wanted, lambda t: F.array_contains(found, t)), lambda matched: judged(wanted, matched))

    def judged(wanted: Column, matched: Column) -> Column:
        all_found, any_wanted = F.size(matched) == F.size(wanted), F.size(wanted) > 0
        hit = {
            "strict": all_found,
            "ignore_num": all_found,
            "any_money": F.size(matched) > 0,
            "half_money": F.coalesce(F.try_divide(F.size(matched), F.size(wanted)) >= HALF_MONEY, F.lit(False)),
        }[mode]
        return F.struct((any_wanted & hit).alias("hit"), matched.alias("matched"), F.filter(wanted, lambda t: ~F.array_contains(found, t)).alias("missing"))

    return let(required if mode == "strict" else _money(required), scored)


def truth_tokens(claim: Column) -> Column:
    """Money and percent figures, then keywords, distinct."""
    return let(claim, lambda c: F.array_distinct(F.concat(_money(reference_figures(c)), keywords(c))))


def _variants(token: Column) -> Column:
    """Spellings of a token that count as a match, in lower case."""

    def money(value: Column) -> Column:
        return F.array_compact(F.array(
            general(value), fixed(value, 0), fixed(value, 2),
            F.when(value >= 1000, general(value / 1000)), F.when(value >= 1000, fixed(value / 1000, 1)),
            F.when(value >= 1_000_000, general(value / 1_000_000)),
        ))

    plain = F.substring_index(token, ":", -1)
    return F.when(token.startswith("usd_m:"), let(plain.try_cast("double"), money)).when(token.startswith("pct:"), F.array(plain)).otherwise(F.array(F.lower(token)))


def token_in_text(token: Column, low: Column) -> Column:
    """Whether any spelling of the token is a substring of the lower-cased text."""
    return F.exists(_variants(token), lambda v: F.contains(low, v))


def match_truth(tokens: Column, text: Column) -> Column:
    """Struct (rate, hit, matched, missing); a claim without tokens is a miss with rate 0."""

    def flagged(x: Column) -> Column:
        return F.transform(x["tokens"], lambda t: F.struct(t.alias("t"), token_in_text(t, x["low"]).alias("found")))

    def scored(flags: Column) -> Column:
        matched = F.transform(F.filter(flags, lambda f: f["found"]), lambda f: f["t"])
        missing = F.transform(F.filter(flags, lambda f: ~f["found"]), lambda f: f["t"])
        return let(F.struct(matched.alias("matched"), missing.alias("missing"), F.size(flags).alias("n")), rated)

    def rated(x: Column) -> Column:
        rate = F.coalesce(F.try_divide(F.size(x["matched"]), x["n"]), F.lit(0.0))
        return F.struct(rate.alias("rate"), (rate > HIT_ABOVE).alias("hit"), x["matched"].alias("matched"), x["missing"].alias("missing"))

    bound = F.struct(tokens.alias("tokens"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    return let(let(bound, flagged), scored)


def passage_indices(reasoning: Column, primary: Column, n_passages: Column) -> Column:
    """Sorted distinct 1-based passages: the primary one and every ``Passage N`` named, within range."""
    named = F.transform(F.regexp_extract_all(F.coalesce(reasoning, F.lit("")), F.lit(r"[Pp]assage\s+(\d+)"), 1), lambda n: n.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(F.array_append(named, primary.cast("int")), lambda i: (i >= 1) & (i <= n_passages))))
