"""Buckets, month ranges and strict dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = ("daily", "monthly", "yearly")
QUERIED = ("day", "week", "month", "year")
_SAME = {"day": "day", "daily": "day", "week": "week", "weekly": "week", "month": "month", "monthly": "month", "year": "year", "yearly": "year"}

DEFAULT_START = dt.date(2011, 1, 1)
SINCE = {"2006": dt.date(2006, 1, 1), "2011": dt.date(2011, 1, 1)}


def parse_granularity(text: str) -> str | None:
    return _SAME.get(text.lower())


_DAY_MS = 86_400_000


def utc_millis(ts: Column, without_zone: bool = False) -> Column:
    """Milliseconds since 1970 of a timestamp, whatever the session's zone. One without a zone
    (``timestamp_ntz``) is read as UTC, from its fields, for a cast would read it in that zone."""
    if not without_zone:
        return F.unix_millis(ts)
    days = F.unix_date(ts.cast("date")).cast("long")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("long")
    return days * _DAY_MS + minutes * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def bucket_of_millis(ms: Column, granularity: str = "daily") -> Column:
    """The UTC bucket of a moment: the day, or the first of its month or year; null where no date has it."""
    days = F.floor(ms / _DAY_MS)
    day = F.when(days.between(-719_162, 2_932_896), F.date_from_unix_date(days.cast("int")))  # years 1 to 9999
    return {"daily": day, "monthly": F.trunc(day, "MM"), "yearly": F.trunc(day, "YYYY")}[granularity].cast("date")


def stored_bucket(ts: Column, granularity: str = "daily") -> Column:
    return bucket_of_millis(utc_millis(ts), granularity)


def query_bucket(bucket: Column, granularity: str) -> Column:
    """The coarser bucket; weeks begin on Sunday."""
    return {
        "day": bucket,
        "week": F.date_sub(bucket, F.dayofweek(bucket) - 1),
        "month": F.trunc(bucket, "MM"),
        "year": F.trunc(bucket, "YYYY"),
    }[granularity].cast("date")


def align(day: dt.date, granularity: str) -> dt.date:
    if granularity == "week":
        return day - dt.timedelta(days=(day.weekday() + 1) % 7)
    return {"day": day, "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[granularity]


def interval(granularity: str) -> Column:
    return F.expr(f"INTERVAL 1 {granularity}")


def calendar(start: Column, end: Column, granularity: str) -> Column:
    """Array of buckets from the aligned ``start`` to the last one not after ``end``; empty if there is none."""
    first = query_bucket(start, granularity)
    return F.when(first <= end, F.sequence(first, end, interval(granularity))).otherwise(F.array().cast("array<date>"))


def parse_date(text: str) -> dt.date | None:
    """A strict YYYY-MM-DD date."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


def parsed_date(text: Column) -> Column:
    """:func:`parse_date` of a column; null where it isn't one."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000"), F.try_to_date(text, "yyyy-MM-dd"))


def parsed_granularity(text: Column) -> Column:
    """:func:`parse_granularity` of a column."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _SAME.items() for x in pair)), F.lower(text))


def bucket_by(bucket: Column, granularity: Column) -> Column:
    """The coarser bucket by a column that names the granularity."""
    out = F.when(granularity == QUERIED[0], query_bucket(bucket, QUERIED[0]))
    for g in QUERIED[1:]:
        out = out.when(granularity == g, query_bucket(bucket, g))
    return out


def month_bounds(day: Column) -> tuple[Column, Column]:
    """The first and the last day of the date's month."""
    return F.trunc(day, "MM"), F.last_day(day)


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def month_end(day: dt.date) -> dt.date:
    following = (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return following - dt.timedelta(days=1)


def parse_month(text: str) -> dt.date:
    """The first day of a YYYY-MM month."""
    match = re.fullmatch(r"(\d{4})-(\d{1,2})", text)
    if not match or not 1 <= int(match[2]) <= 12:
        raise ValueError(f"not a month: {text!r}")
    return dt.date(int(match[1]), int(match[2]), 1)


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(month date) from ``start`` to ``end``, both included; empty if they are the wrong way round."""
    first, last = parse_month(start), parse_month(end)
    if first > last:
        return spark.createDataFrame([], "month date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def bucket_end_ms(bucket: Column) -> Column:
    """Milliseconds since 1970 of the end of the bucket's first day."""
    return (F.unix_date(bucket).cast("long") + 1) * F.lit(_DAY_MS).cast("long")


def ms_to_date(ms: Column) -> Column:
    return bucket_of_millis(ms)
