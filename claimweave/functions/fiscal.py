"""Fiscal calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_end_month(mmdd: Column) -> Column:
    """Month of a fiscal year end given as MMDD; December where it is none."""
    month = F.substring(F.lpad(F.trim(mmdd.cast("string")), 4, "0"), 1, 2).try_cast("int")
    return F.when(month.between(1, 12), month).otherwise(F.lit(12))


def iso_date(value: Column) -> Column:
    """Date from the first ten characters, or null."""
    return F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")


def quarter_end_month(fye_month: Column, quarter: Column) -> Column:
    """Last month of quarter 1..4; null outside the calendar."""
    good = fye_month.between(1, 12) & quarter.between(1, 4)
    return F.when(good, F.pmod(fye_month - 1 + 3 * quarter, F.lit(12)) + 1)


def quarter_end_year(fiscal_year: Column, fye_month: Column, quarter: Column) -> Column:
    """A quarter that ends in a later month than the fiscal year does belongs to the calendar year before."""
    return F.when(quarter_end_month(fye_month, quarter) > fye_month, fiscal_year - 1).otherwise(fiscal_year)


def quarter_period(fiscal_year: Column, fye_month: Column, quarter: Column) -> Column:
    """Struct (label, end_month, end_year, months) with the three months ascending as yyyy-MM."""
    month, year = quarter_end_month(fye_month, quarter), quarter_end_year(fiscal_year, fye_month, quarter)
    last = F.make_date(year, month, F.lit(1))
    months = F.transform(F.sequence(F.lit(2), F.lit(0), F.lit(-1)), lambda i: F.date_format(F.add_months(last, -i), "yyyy-MM"))
    return F.struct(
        F.format_string("FY%d Q%d", fiscal_year, quarter).alias("label"),
        month.alias("end_month"), year.alias("end_year"), months.alias("months"),
    )


def fiscal_year_of(report: Column, fye_month: Column) -> Column:
    """Fiscal year that a report date falls in."""
    return F.when(F.month(report) > fye_month, F.year(report) + 1).otherwise(F.year(report))


def report_match_score(report: Column, fiscal_year: Column, fye_month: Column, quarter: Column) -> Column:
    """Lower is better: months apart (circular) times 100, and days from the 28th; null: no candidate."""
    apart = F.abs(F.month(report) - quarter_end_month(fye_month, quarter))
    months = F.least(apart, 12 - apart)
    fits = (fiscal_year_of(report, fye_month) == fiscal_year) & (months <= 1)
    return F.when(fits, months * 100 + F.abs(F.dayofmonth(report) - 28))
