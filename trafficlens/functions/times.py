"""Column expressions on time: parsing, buckets, calendar parts, cycles."""

import math

from pyspark.sql import Column, functions as F

from trafficlens import fixed_values as V

# Buckets are counted from here: a midnight before any log.
ORIGIN = "0001-01-01 00:00:00"


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


def origin() -> Column:
    return F.lit(ORIGIN).cast("timestamp_ntz")


def parse_log_time(text: Column) -> Column:
    """Local wall-clock time of the line; the zone offset is dropped, bad text is null."""
    found = F.regexp_extract(text, V.LOG_TIME_PATTERN, 1)
    # An ISO text becomes a zone-free time directly, whatever the session's zone.
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m.lower(), f"{i + 1:02d}")])
    iso = F.concat(
        F.substring(found, 8, 4), F.lit("-"), months[F.lower(F.substring(found, 4, 3))], F.lit("-"),
        F.substring(found, 1, 2), F.lit(" "), F.substring(found, 13, 8))
    return iso.try_cast("timestamp_ntz")


def parse_iso_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` and nothing else."""
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp_ntz"))


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def as_zoned(ts: Column) -> Column:
    """A zoned time with the same clock in UTC, whatever the session's zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return F.timestamp_seconds(days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def _after(start: Column, days: Column, unit: str, rest: Column) -> Column:
    # Days apart from the rest: seconds or minutes alone pass 32 bits in far years.
    return F.timestamp_add(unit, rest.cast("int"), F.timestamp_add("DAY", days.cast("int"), start))


def as_zone_free(ts: Column) -> Column:
    seconds = F.unix_seconds(ts)
    return _after(epoch(), F.floor(seconds / 86400), "SECOND", F.pmod(seconds, F.lit(86400)))


def bucket_number(ts: Column, minutes) -> Column:
    """Number of whole buckets since the origin; ``minutes`` may be a column."""
    # Days, hours and minutes of a zone-free time need no zone; differences of times do.
    days = F.date_diff(F.to_date(ts), F.to_date(origin())).cast("long")
    passed = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    step = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.floor(passed / step).cast("long")


def bucket_time(number: Column, minutes) -> Column:
    step = minutes if isinstance(minutes, Column) else F.lit(minutes)
    passed = number * step
    return _after(origin(), F.floor(passed / 1440), "MINUTE", F.pmod(passed, F.lit(1440)))


def bucket_start(ts: Column, minutes: int) -> Column:
    """Start of the bucket, left-closed and aligned to midnight."""
    return F.window(ts, f"{minutes} minutes").start


def calendar(ts: Column) -> dict[str, Column]:
    """hour, weekday with Monday 0, weekend flag."""
    return {
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("byte"),
    }


def row_calendar(ts: Column) -> dict[str, Column]:
    parts = calendar(ts)
    return {
        "hour": parts["hour"],
        "day": F.day(ts),
        "weekday": parts["weekday"],
        "month": F.month(ts),
        "is_weekend": F.coalesce(parts["is_weekend"].cast("int"), F.lit(0)),
    }


def cycle(part: Column, length: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * part / F.lit(length)
    return F.sin(angle), F.cos(angle)
