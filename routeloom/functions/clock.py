"""Service-day clocks and civil dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIVIL_ZONE = "Asia/Seoul"
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def clock_seconds(c: Column, most_hours: int = 47) -> Column:
    """Seconds of HH:MM:SS with hours up to 47; null if it is no such clock."""
    part = F.regexp_extract(c, r"^(\d{1,2}):([0-5]\d):([0-5]\d)$", 0)
    p = F.split(c, ":")
    s = F.try_element_at(p, F.lit(1)).try_cast("int") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("int") * 60 + F.try_element_at(p, F.lit(3)).try_cast("int")
    return F.when((part != "") & (s < (most_hours + 1) * 3600), s)


def clock_minutes(c: Column, most_hours: int = 23) -> Column:
    p = F.split(c, ":")
    s = F.try_element_at(p, F.lit(1)).try_cast("int") * 60 + F.try_element_at(p, F.lit(2)).try_cast("int")
    return F.when(c.rlike(r"^\d{1,2}:[0-5]\d$") & (s < (most_hours + 1) * 60), s)


def clock_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


def feed_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))


def civil_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, CIVIL_ZONE))


def time_bucket(instant: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(instant) / (seconds * 1_000_000)).cast("long")


def runs_on(day: Column, start: Column, end: Column, weekdays: list[Column], exception: Column) -> Column:
    """A calendar exception decides (1 adds, 2 removes); without one the range and weekday flag do."""
    flag = F.element_at(F.array(*weekdays), F.weekday(day) + 1)
    return F.when(exception.isNotNull(), exception == 1).otherwise(day.between(start, end) & flag)


def next_day_minutes(departure: Column, scheduled: Column) -> Column:
    return F.when(departure < scheduled, departure + 1440).otherwise(departure)


def absolute_seconds(seconds: Column, day_offset: Column) -> Column:
    """Seconds of a service day on the clock of the civil day that lies ``day_offset`` days before it."""
    return (seconds + day_offset * 86_400).cast("long")


def civil_timestamp(day: Column, seconds: Column) -> Column:
    """The instant so many seconds after the civil day's midnight, as text with its zone."""
    at = F.timestamp_add("SECOND", seconds, day.cast("timestamp_ntz"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def operation_midnight(c: Column) -> Column:
    """UTC midnight of a yyyyMMdd date; null if it is none."""
    return feed_date(c).cast("timestamp")
