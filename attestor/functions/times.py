"""Columns over instants and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What each field of a digit string may be, longest form first, as a regular expression.
FIELDS = {"Y": "([0-9]{4})", "m": "(1[0-2]|0[1-9]|[1-9])", "d": "(3[01]|[12][0-9]|0[1-9]|[1-9])", "H": "(2[0-3]|[01][0-9]|[0-9])", "M": "([0-5][0-9]|[0-9])", "S": "(6[01]|[0-5][0-9]|[0-9])"}
#: The fields that a digit string of each length is read by; 15 and more digits count by their first 14. Other lengths are dates by their first 8.
READ_BY = {8: "YmdH", 10: "YmdH", 12: "YmdHM", 14: "YmdHMS"}


def _by_fields(digits: Column, fields: str) -> Column:
    """The instant that digits give if the fields, each as long as it can be, use all of them; null otherwise."""
    pattern = "^" + "".join(FIELDS[f] for f in fields)
    part = lambda k, f: F.lpad(F.regexp_extract(digits, pattern, k), 4 if f == "Y" else 2, "0")
    parts = [part(k, f) for k, f in enumerate(fields, 1)] + [F.lit("00")] * (6 - len(fields))
    made = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit(" "), parts[3], F.lit(":"), parts[4], F.lit(":"), parts[5])
    fits = (F.length(F.regexp_extract(digits, pattern, 0)) == F.length(digits)) & ~digits.startswith("0000")
    return F.when(fits, F.try_to_timestamp(made, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_instant(text: Column) -> Column:
    """Eight or more digits, else ISO text; null for what is neither.

    Digits are read by the fields of their length; where that fails, their first
    eight are a date. Eight digits are tried as year, month, day and hour first, so
    20241105 is the tenth of January at five, while 20240305 is the fifth of March.
    """
    t = F.trim(text)
    n = F.length(t)
    first = _by_fields(F.left(t, F.lit(14)), READ_BY[14])
    read = F.when(n >= 14, first)
    for length, fields in READ_BY.items():
        if length < 14:
            read = read.when(n == length, _by_fields(t, fields))
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.,]+(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"), F.try_to_timestamp(t))
    return F.when(t.rlike("^[0-9]+$"), F.when(n >= 8, F.coalesce(read, _by_fields(F.left(t, F.lit(8)), "Ymd")))).otherwise(iso)


def _clock(total: Column) -> Column:
    h, m, r = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    t = lambda c: c.cast("long").cast("string")
    seconds = F.concat(t(r), F.lit("s"))
    minutes = F.concat(t(m), F.lit("m "), seconds)
    return F.when(h > 0, F.concat(t(h), F.lit("h "), minutes)).when(m > 0, minutes).otherwise(seconds)


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds without leading zero parts, to the nearest second (halves to even); a dash for null."""
    return F.when(seconds.isNull(), "—").otherwise(_clock(F.rint(F.greatest(F.lit(0.0), seconds.cast("double"))).cast("long")))


def instant_text(at: Column) -> Column:
    """A UTC instant that does not wrap; a dash for null."""
    return F.when(at.isNull(), "—").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'"))


def relative_age(at: Column, now: Column) -> Column:
    """How long ago: seconds under a minute, minutes under an hour, hours under 48, days; never negative, unknown for null."""
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000))
    ago = lambda k, unit: F.concat(F.floor(s / k).cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(at.isNull(), "unknown").when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 172_800, ago(3600, "h")).otherwise(ago(86_400, "d"))


def age_seconds(at: Column, now: Column) -> Column:
    """Seconds between two instants, at least 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 1_000_000)


def backoff(attempt: Column, retry_after: Column, cap: float = 30.0) -> Column:
    """Seconds before the next try: what the answer asks for, else a power of two; both capped."""
    return F.when(retry_after.isNotNull(), F.least(F.lit(cap), retry_after)).otherwise(F.least(F.lit(cap), F.pow(F.lit(2.0), attempt)))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that an answer asks to wait, given as a number or as a date; at most 60, null for neither."""
    t = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), " (GMT|UTC)$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(t.rlike("^[0-9]+$"), t.cast("double")).otherwise(F.greatest(F.lit(0.0), (F.unix_micros(date) - F.unix_micros(now)) / 1_000_000))
    return F.when(t.rlike("^[0-9]+$") | date.isNotNull(), F.least(F.lit(60.0), seconds))
