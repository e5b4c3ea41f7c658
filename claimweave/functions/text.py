"""Text scalars: white space, search tokens, keywords, headers for embedding and reranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was were are be been being have has had we our us it its "
    "this that these those than over year years quarter quarters during about also up down compared versus vs million "
    "millions billion billions percent growth increased decrease decreased strong record approximately"
).split()


def normalize_ws(value: Column) -> Column:
    """No-break spaces to spaces, runs of spaces and tabs to one, three newlines or more to two, trimmed."""
    plain = F.regexp_replace(F.replace(value, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


#: One token: a run of letters, digits, ``$`` and ``%`` and the decimals after it, without ``$`` and ``%`` at its ends.
#: Nothing is left for lambdas to do, so the split stays one call a text.
TOKEN = r"(?<![$%])[$%]*+((?:[a-z0-9][a-z0-9$%]*|(?<=[$%]))\.[0-9]+|[a-z0-9](?:[a-z0-9$%]*[a-z0-9])?)"


def tokens(value: Column) -> Column:
    """Search tokens: commas removed, lower case, letters, digits and decimals, ``$`` and ``%`` stripped."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit(""))), F.lit(TOKEN), 1)


def keywords(value: Column) -> Column:
    """Distinct words of three characters or more in order of first occurrence, stopwords removed."""
    words = F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(?i)([a-z][a-z0-9'-]{2,})"), 1), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS)))


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)  # null where the value is


def embedding_text(c=F.col) -> Column:
    """Bracketed header of what a chunk is, a newline, its text.  Absent parts are left out."""
    name = F.coalesce("company_name", "ticker")
    period = F.concat_ws(" ", "fiscal_period", F.col("fiscal_year").cast("string"))
    speaker = F.when(F.col("speaker_name").isNotNull(), F.concat("speaker_name", F.coalesce(F.concat(F.lit(" ("), "speaker_role", F.lit(")")), F.lit(""))))
    filing = F.concat_ws(
        " | ", _tag("COMPANY", F.col("ticker")), _tag("NAME", name), _tag("PERIOD", F.coalesce("quarter_period_label", period)), _tag("TYPE", F.col("doc_type")),
        _tag("SECTION", F.coalesce("section", F.lit("Unknown"))), _tag("TABLE", F.when(F.col("is_table"), "True").otherwise("False")),
        _tag("FILING_DATE", F.col("filing_date")), _tag("REPORT_DATE", F.col("report_date")),
        F.when(F.size("quarter_months") > 0, _tag("QUARTER_MONTHS", F.array_join("quarter_months", ","))),
    )
    call = F.concat_ws(
        " | ", _tag("COMPANY", F.col("ticker")), _tag("NAME", name), _tag("PERIOD", F.coalesce("quarter_period_label", period)), _tag("TYPE", F.col("doc_type")),
        _tag("SPEAKER", speaker), _tag("CALL_DATE", F.col("call_date")),
    )
    head = F.when(F.col("doc_type") == "transcript", call).otherwise(filing)
    return F.concat(F.lit("["), head, F.lit("]\n"), F.trim("text"))


def rerank_text() -> Column:
    """A lighter header for the reranker."""
    head = F.concat_ws(" | ", "ticker", F.concat_ws(" ", "fiscal_period", F.col("fiscal_year").cast("string")), "doc_type", F.coalesce("section", "speaker_name"))
    return F.concat(F.lit("["), head, F.lit("]\n"), F.trim("text"))


def last_break(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last ``. `` or ``; `` past half of it where there is one."""
    text = collapse(value)
    head = F.substring(text, 1, limit)
    at = F.greatest(*[F.length(head) - F.instr(F.reverse(head), mark[::-1]) - 1 + F.when(F.instr(head, mark) == 0, -limit).otherwise(0) for mark in (". ", "; ")])
    return F.when(F.length(text) <= limit, text).otherwise(F.when(at > limit // 2, F.substring(head, F.lit(1), at + 1)).otherwise(F.rtrim(head)))
