"""Timestamps, local dates and hour buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOCAL_ZONE = "Europe/Prague"
HOUR_BUCKETS = ["00-05", "06-11", "12-17", "18-23"]


def run_time(text: Column) -> Column:
    """Timestamp from ISO text, ``YYYY-MM-DD-HH-MM``, a date, or epoch milliseconds; else null."""
    t = F.trim(text)
    return (
        F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}-\d{2}-\d{2}$")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd-HH-mm")))
        .when(F.regexp_like(t, F.lit(r"^\d{9,}$")), F.timestamp_millis(F.when(F.length(t) <= 17, t.try_cast("long"))))
        .otherwise(t.try_cast("timestamp"))
    )


def local_time(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(utc, zone)


def zone_offset(utc: Column, local: Column) -> Column:
    """Offset text such as ``+02:00`` between a UTC time and its local clock time."""
    minutes = ((local.cast("long") - utc.cast("long")) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours = F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0")
    return F.concat(sign, hours, F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def hour_bucket(hour: Column) -> Column:
    """Quarter of the day; the last one also takes hours out of range, null stays null."""
    return (
        F.when(hour.isNull(), F.lit(None).cast("string"))
        .when(hour.between(0, 5), HOUR_BUCKETS[0])
        .when(hour.between(6, 11), HOUR_BUCKETS[1])
        .when(hour.between(12, 17), HOUR_BUCKETS[2])
        .otherwise(HOUR_BUCKETS[3])
    )


def day_in_window(stamp: Column, first_day: str, last_day: str) -> Column:
    """True where the day part of a compact timestamp lies in the window; empty text never does."""
    return F.coalesce((stamp != "") & F.substring(stamp, 1, 10).between(first_day, last_day), F.lit(False))
