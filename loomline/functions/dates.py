"""Dates as boards, exports and models write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomline.functions.keys import text

# The written forms, in the order in which they are tried.
FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"), (r"^\d{4}-\d{1,2}$", "yyyy-M"),
)
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def written_date(c: Column | str) -> Column:
    """The date that a text names in one of ``FORMS``, or in its first ten characters; null for anything else."""
    t = F.trim(text(c))
    out = F.lit(None).cast("date")
    for shape, form in reversed(FORMS):
        out = F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form)).cast("date")).otherwise(out)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}."), F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")).otherwise(out)


def feed_date(c: Column | str) -> Column:
    """A date of a feed: epoch seconds or milliseconds (above 1e11), an ISO prefix or ``m/d/yyyy``."""
    t = F.trim(text(c))
    number = F.try_to_number(t, F.lit("9" * 15)).cast("bigint")
    seconds = F.when(number > 100_000_000_000, (number / 1000).cast("bigint")).otherwise(number)
    of_number = F.timestamp_seconds(seconds).cast("date")
    iso = F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    us = F.try_to_timestamp(t, F.lit("M/d/yyyy")).cast("date")
    return F.when(t.rlike(r"^0*$"), None).when(t.rlike(r"^\d{1,15}$"), of_number).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), us)


def relative_date(c: Column | str, today: Column) -> Column:
    """The date of "today", "yesterday" or "30+ days ago"; a plus adds a day; null for anything else."""
    low = F.lower(text(c))
    count = F.try_to_number(F.nullif(F.regexp_extract(low, r"(\d{1,5})\+?\s*(?:day|week|month|year)", 1), F.lit("")), F.lit("99999")).cast("int")
    unit = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])[F.regexp_extract(low, r"\d\+?\s*(day|week|month|year)", 1)]
    back = count * unit + F.when(low.contains("+"), 1).otherwise(0)
    return F.when(low.contains("today") | low.contains("just posted"), today).when(low.contains("yesterday"), F.date_sub(today, 1)).otherwise(F.date_sub(today, back))
