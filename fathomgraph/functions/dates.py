"""Time is an integer number of days since 1990-01-01; a year cut-off includes 31 December."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = date(1990, 1, 1)


def day_offset(day: Column) -> Column:
    return F.datediff(day, F.lit(ORIGIN))


def cutoff_day(year: int) -> int:
    return (date(year, 12, 31) - ORIGIN).days


def preprint_date(created: Column) -> Column:
    """Date of a text such as ``Mon, 2 Apr 2007 19:18:42 GMT`` (weekday and clock are ignored)."""
    return F.try_to_timestamp(F.regexp_extract(created, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")).cast("date")


def iso_date(text: Column) -> Column:
    """Date of a strict ``YYYY-MM-DD`` text, null when missing or not a date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
