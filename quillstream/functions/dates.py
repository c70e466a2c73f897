"""Text and numbers to UTC timestamps; what can't be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def iso_to_utc(text: Column) -> Column:
    """ISO 8601 with ``Z`` or an offset; without either it is UTC."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def rfc822_to_utc(text: Column) -> Column:
    """Dates of RSS feeds. The weekday says nothing new and is not read."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    offset = F.regexp_replace(plain, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.try_to_timestamp(offset, F.lit("d MMM yyyy HH:mm:ss Z"))


def eastern_to_utc(local: Column) -> Column:
    return F.to_utc_timestamp(local, EASTERN)


def wire_time_to_utc(text: Column) -> Column:
    """``Aug 15, 2025, 17:04 ET``."""
    return eastern_to_utc(F.try_to_timestamp(F.regexp_replace(F.trim(text), r"\s*ET$", ""), F.lit("MMM d, yyyy, HH:mm")))


def acceptance_to_utc(submission: Column) -> Column:
    """The acceptance time of a submission's header: 14 digits, Eastern time."""
    digits = F.regexp_extract(submission, r"(?i)<ACCEPTANCE-DATETIME>\s*(\d{14})", 1)
    return eastern_to_utc(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")))


def millis_or_iso_to_utc(text: Column) -> Column:
    """Epoch milliseconds where the text is a number, else ISO 8601. Numbers beyond the year 9999 are no times."""
    number = text.try_cast("bigint")
    sane = F.when(number.between(-62_135_596_800_000, 253_402_300_799_999), number)
    return F.coalesce(F.timestamp_millis(sane), iso_to_utc(text))


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(start: Column, end: Column) -> Column:
    """All days from one to the other, both included, in whichever order they are given."""
    return F.sequence(F.least(start, end), F.greatest(start, end))
