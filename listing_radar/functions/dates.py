"""Date expressions; the current time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FORMATS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
]


def parse_feed_date(c: Column) -> Column:
    """ISO 8601 or mail-style date as UTC; a missing offset means UTC, anything else is null."""
    text = F.trim(F.coalesce(c, F.lit("")))
    mail = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    mail = F.regexp_replace(mail, r"(?i)\s*(GMT|UTC|UT|Z)$", " +0000")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(mail, F.lit(fmt)) for fmt in _FORMATS])


def estimate_delivery(year: Column, quarter: Column) -> Column:
    """Last day of the quarter; the fourth one if it is not given."""
    month = F.least(F.greatest(F.coalesce(quarter, F.lit(4)), F.lit(1)), F.lit(4)) * 3
    return F.when(year.isNotNull(), F.last_day(F.make_date(year, month, F.lit(1))))


def batch_ranges(first: Column, last: Column, days: int) -> Column:
    """Contiguous inclusive ranges of at most ``days`` days as array<struct<sequence,from,to>>."""
    if not 1 <= days <= 367:
        raise ValueError("a batch covers 1 to 367 days")
    starts = F.sequence(first, last, F.expr(f"interval {days} days"))
    return F.transform(
        starts,
        lambda start, i: F.struct(
            (i + 1).alias("sequence"), start.alias("from"), F.least(last, F.date_add(start, days - 1)).alias("to")
        ),
    )


def expand_dates(first: Column, last: Column, cadence: Column) -> Column:
    """Dates of the requests a feed needs: every day, the first of every month, or the last day once."""
    return (
        F.when(cadence == "daily", F.sequence(first, last, F.expr("interval 1 day")))
        .when(
            cadence == "monthly",
            F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")),
        )
        .otherwise(F.array(last))
    )


def dated_url(template: Column, day: Column) -> Column:
    out = F.replace(template, F.lit("{date:yyyyMMdd}"), F.date_format(day, "yyyyMMdd"))
    out = F.replace(out, F.lit("{date:yyyyMM}"), F.date_format(day, "yyyyMM"))
    return F.replace(out, F.lit("{date:dd%2FMM%2Fyyyy}"), F.date_format(day, "dd'%2F'MM'%2F'yyyy"))
