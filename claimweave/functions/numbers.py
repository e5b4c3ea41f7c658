"""Number formatting, and naming of intermediate values, shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def general(value: Column) -> Column:
    """C's ``%g``: six significant digits, no trailing zeros."""
    return F.regexp_replace(F.format_string("%g", value), r"\.0+(?=$|e)|(?<=\.\d{1,9})0+(?=$|e)", "")


def fixed(value: Column, digits: int) -> Column:
    """``%,.Nf`` with thousands separators."""
    return F.format_string(f"%,.{digits}f", value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it.

    Expressions inside a lambda are not shared by the planner; a value bound here is.
    """
    return F.transform(F.array(value), body)[0]


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column, which filters and projections above read instead of computing it again.

    The planner merges projections and repeats a costly expression in each of their uses; it stops at a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
