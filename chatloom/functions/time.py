"""Times: epoch seconds in, calendar fields out (in the session's time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(value: Column) -> Column:
    """Seconds of a number of seconds or, above 10^12, of milliseconds; null and unreadable: 0."""
    n = F.coalesce(value.try_cast("bigint"), F.lit(0))
    return F.when(n > 1_000_000_000_000, (n - n % 1000) / 1000).otherwise(n).cast("bigint")


def seconds_of_any(value: Column) -> Column:
    """Seconds of a number of seconds, milliseconds, microseconds or nanoseconds."""
    n = F.coalesce(value.try_cast("bigint"), F.lit(0))
    for _ in range(4):
        n = F.when(n > 10_000_000_000, ((n - n % 1000) / 1000).cast("bigint")).otherwise(n)
    return n


def parse_seconds(text: Column) -> Column:
    """Seconds of a number, of yyyyMMddHHmmss or yyyyMMdd digits, or of a date text; else null."""
    t = F.trim(text.cast("string"))
    compact = F.when(F.rlike(t, F.lit("^(19|20)[0-9]{12}$")), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))).when(F.rlike(t, F.lit("^(19|20)[0-9]{6}$")), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
    number = F.when(F.rlike(t, F.lit("^[0-9]+$")), seconds_of_any(t))
    return F.coalesce(F.unix_timestamp(compact), number, F.unix_timestamp(F.try_to_timestamp(t)))


def moment(create_time: Column) -> Column:
    return F.timestamp_seconds(create_time)


def day(create_time: Column) -> Column:
    return F.to_date(moment(create_time))


def day_key(create_time: Column) -> Column:
    return F.date_format(moment(create_time), "yyyy-MM-dd")


def month_key(create_time: Column) -> Column:
    return F.date_format(moment(create_time), "yyyy-MM")


def hour(create_time: Column) -> Column:
    return F.hour(moment(create_time))


def weekday(create_time: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(moment(create_time)) + 1


def clock(create_time: Column) -> Column:
    return F.date_format(moment(create_time), "yyyy-MM-dd HH:mm:ss")


def iso(create_time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(moment(create_time), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def in_range(create_time: Column, begin: int = 0, end: int = 0) -> Column:
    """Both bounds inclusive; 0 is no bound; an end before the beginning is an error. Times of 0 and less never count."""
    if begin and end and end < begin:
        raise ValueError("the range ends before it begins")
    test = create_time > 0
    if begin:
        test &= create_time >= begin
    if end:
        test &= create_time <= end
    return test


def export_range(begin: int | None, end: int | None) -> tuple[int, int] | None:
    """Bounds of an export: turned round when reversed, none when both are missing."""
    if not (begin and begin > 0) and not (end and end > 0):
        return None
    low, high = begin or 0, end or 0
    return (high, low) if high and low > high else (low, high)


def day_range(day_text: Column) -> Column:
    """struct<begin, end> of a yyyy-MM-dd day: its first second and that of the next day; null for no day."""
    d = F.try_to_date(day_text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(day_text, F.lit("yyyy-MM-dd")))
    return F.when(d.isNotNull(), F.struct(F.unix_timestamp(d.cast("timestamp")).alias("begin"), F.unix_timestamp(F.date_add(d, 1).cast("timestamp")).alias("end")))


PRESETS = {"today": 0, "yesterday": 1, "last3days": 2, "last7days": 6, "last30days": 29}


def preset_range(name: str, today: Column) -> Column:
    """struct<first, last> of days for a named range that ends today (yesterday: then)."""
    if name in ("last1year", "last2years"):
        first = F.add_months(today, -12 if name == "last1year" else -24)
    else:
        first = F.date_sub(today, PRESETS[name])
    last = F.date_sub(today, 1) if name == "yesterday" else today
    return F.struct(first.alias("first"), last.alias("last"))


# Names of stored ranges, of now and of old, and days of the range that has no name any more.
STORED = ("all", "today", "yesterday", "last3days", "last7days", "last30days", "last1year", "last2years")
OLD_NAMES = {"7d": "last7days", "30d": "last30days"}
OLD_DAYS = {"90d": 90}
# End of fixed values.


def stored_moment(value: Column) -> Column:
    """Seconds of a stored date: yyyy-MM-dd with or without HH:mm, another form of time, or digits of milliseconds; else null."""
    t = F.trim(value.cast("string"))
    forms = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm")], F.try_to_timestamp(t))
    return F.when(F.rlike(t, F.lit("^[0-9]{9,16}$")), F.floor(t.try_cast("bigint") / 1000)).otherwise(F.unix_timestamp(forms))


def stored_range(preset: Column, all_time: Column, start: Column, end: Column, now: Column) -> Column:
    """struct<preset, all_time, begin, end> of a stored range at ``now``; begin and end are seconds, null for all time.

    A known name counts first, then two dates (an end before its start is its start);
    anything else is today.
    """
    name = preset
    for old, new in OLD_NAMES.items():
        name = F.when(preset == old, new).otherwise(name)
    whole = F.coalesce(all_time, F.lit(False)) | F.coalesce(name == "all", F.lit(False))
    a, b = stored_moment(start), stored_moment(end)

    def ranged(kind: Column, begin: Column, stop: Column) -> Column:
        return F.struct(kind.alias("preset"), F.lit(False).alias("all_time"), begin.cast("bigint").alias("begin"), stop.cast("bigint").alias("end"))

    out = F.when(whole, F.struct(F.lit("all").alias("preset"), F.lit(True).alias("all_time"), F.lit(None).cast("bigint").alias("begin"), F.lit(None).cast("bigint").alias("end")))
    for known in STORED[1:]:
        days = preset_range(known, day(now))
        stop = F.unix_timestamp(day(now).cast("timestamp")) - 1 if known == "yesterday" else now
        out = out.when(name == known, ranged(F.lit(known), F.unix_timestamp(days["first"].cast("timestamp")), stop))
    for old, n in OLD_DAYS.items():
        days = last_days_range(now, n)
        out = out.when(preset == old, ranged(F.lit("custom"), days["begin"], days["end"]))
    out = out.when(a.isNotNull() & b.isNotNull(), ranged(F.lit("custom"), a, F.greatest(a, b)))
    return out.otherwise(ranged(F.lit("today"), F.unix_timestamp(day(now).cast("timestamp")), now))


def last_days_range(now: Column, days: int) -> Column:
    """struct<begin, end>: from the first second of the day ``days`` - 1 days before that of ``now`` to ``now``."""
    first = F.unix_timestamp(F.date_sub(day(now), max(1, days) - 1).cast("timestamp"))
    return F.struct(first.alias("begin"), now.cast("bigint").alias("end"))


def month_window(create_time: Column) -> Column:
    """struct<begin, end> of the month that holds a time: its first second and that of the next month."""
    first = F.trunc(day(create_time), "month")
    return F.struct(F.unix_timestamp(first.cast("timestamp")).alias("begin"), F.unix_timestamp(F.add_months(first, 1).cast("timestamp")).alias("end"))
