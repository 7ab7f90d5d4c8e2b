"""Dates: tolerant parsing, civil days in a time zone, windows."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def civil_day(day: str, zone: str) -> tuple[str, str]:
    """UTC bounds [a, b) of a civil day in a zone, as text."""
    a = datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(zone))
    b = (datetime.fromisoformat(day) + timedelta(days=1)).replace(tzinfo=ZoneInfo(zone))
    return tuple(x.astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%d %H:%M:%S") for x in (a, b))


def parse_moment(c: Column) -> Column:
    """A timestamp in any of the known formats, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def second_diff(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps, each cut to its second first, as ``date_diff`` of SQL counts them."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", start), F.date_trunc("second", end))


def parse_day_br(c: Column) -> Column:
    """dd/mm/yyyy, or the date of yyyymmddhhmmss, else null."""
    a = F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))
    b = F.when(c.rlike(r"^\d{14}$"), F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))
    return F.to_date(F.coalesce(a, b))


def chunks(start: Column, end: Column, days: int) -> Column:
    """[(from, to)] windows of ``days`` days, inclusive, that cover [start, end]."""
    starts = F.sequence(start, end, F.expr(f"INTERVAL {days} DAYS"))
    return F.transform(starts, lambda a: F.struct(a.alias("from"), F.least(F.date_add(a, days - 1), end).alias("to")))


def halves(start: Column, end: Column) -> Column:
    """A window cut in two; a single day stays one window."""
    mid = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return F.when(start < end, F.array(F.struct(start.alias("from"), mid.alias("to")), F.struct(F.date_add(mid, 1).alias("from"), end.alias("to")))).otherwise(F.array(F.struct(start.alias("from"), end.alias("to"))))


def months(days: Column) -> Column:
    return days / 30.44


def payment_year(order_day: Column) -> Column:
    """The year a court order is due: ordered by 2 April, at the end of the next year, else a year later."""
    late = order_day > F.make_date(F.year(order_day), F.lit(4), F.lit(2))
    return F.year(order_day) + F.when(late, 2).otherwise(1)
