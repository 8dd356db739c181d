"""Dates and instants as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"


def instant(text: Column) -> Column:
    """An ISO 8601 text as a timestamp; null if it does not parse or names no offset."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def market_date(ts: Column) -> Column:
    """The date in New York of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, MARKET_ZONE))


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def is_year_long(start: Column, end: Column) -> Column:
    return days_inclusive(start, end).between(330, 380)


def age_hours(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(3.6e9)


def document_date(text: Column) -> Column:
    """A date written as ISO or as "September 27, 2025"."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MMMM d, yyyy"))
