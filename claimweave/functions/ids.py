"""Identity and normalisation rules of periods, claims and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_number(value: Column) -> Column:
    """1..4 from ``3``, ``"3"``, ``"q3"``; null where it is none of these."""
    return F.regexp_extract(F.upper(F.trim(value.cast("string"))), r"^Q?([1-4])$", 1).try_cast("int")


def quarter_label(value: Column) -> Column:
    return F.concat(F.lit("Q"), quarter_number(value).cast("string"))


def strict_quarter(value: Column) -> Column:
    """As ``quarter_label``, but a value that is no quarter is an error."""
    label = quarter_label(value)
    return F.when(label.isNull(), F.raise_error(F.concat(F.lit("not a fiscal quarter: "), F.coalesce(value.cast("string"), F.lit("null"))))).otherwise(label)


def claim_id(ticker: Column, year: Column, quarter: Column, index: Column) -> Column:
    """``index`` counts from 1 inside a period."""
    return F.format_string("%s_%d_%s_%02d", F.upper(ticker), year, quarter, index)


def chunk_id(ticker: Column, year: Column, period: Column, doc_type: Column, index: Column) -> Column:
    """``index`` counts from 0 in document order."""
    return F.format_string("%s_%d_%s_%s_chunk_%d", ticker, year, period, doc_type, index)


def resolved_form(form: Column, quarter: Column) -> Column:
    """A stated 10-K or 10-Q, else the annual form for Q4 and the quarterly one otherwise."""
    stated = F.upper(F.trim(form))
    return F.when(stated.isin("10-K", "10-Q"), stated).otherwise(F.when(quarter == "Q4", "10-K").otherwise("10-Q"))


def fiscal_period(doc_type: Column, quarter: Column) -> Column:
    return F.when(doc_type == "10-K", F.lit("FY")).otherwise(quarter)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def listed(value: Column) -> Column:
    """A string array without null and blank members; empty: null."""
    kept = F.filter(F.transform(value, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)
