"""Validation and normalisation: what is not acceptable becomes NULL (NaN where a record in flight asks for it)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_TICKER, LONGEST_NAME, LONGEST_TEXT = 10, 200, 500
#: Larger magnitudes are taken for errors. Note that this drops market values above 10^12.
LARGEST = 1e12


def ticker(raw: Column) -> Column:
    """Upper case letters, digits, dot and hyphen of a text of at most 10 characters (before cleaning)."""
    cleaned = F.upper(F.regexp_replace(raw, r"[^\p{L}\p{N}.-]", ""))
    return F.when(F.length(raw) <= LONGEST_TICKER, F.nullif(cleaned, F.lit("")))


def _trimmed(raw: Column, longest: int) -> Column:
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return F.when((F.length(text) > 0) & (F.length(text) <= longest), text)


def company_name(raw: Column) -> Column:
    return _trimmed(raw, LONGEST_NAME)


def text(raw: Column) -> Column:
    return _trimmed(raw, LONGEST_TEXT)


def numeric(raw: Column) -> Column:
    x = raw.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) <= LARGEST), x)


def number_or_nan(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("double"), F.lit(float("nan")))


def present(x: Column) -> Column:
    """Neither NULL nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def surprise(actual: Column, estimate: Column) -> Column:
    """Actual less estimate, NaN unless both are present."""
    return F.when(present(actual) & present(estimate), actual - estimate).otherwise(F.lit(float("nan")))


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def unset_to_null(x: Column, kind: str) -> Column:
    """Broker sentinels for "not set" to NULL."""
    unset = {"int": (1 << 31) - 1, "long": (1 << 63) - 1, "double": 1.7976931348623157e308}[kind]
    return F.nullif(x, F.lit(unset))


def percent(done: Column, total: Column) -> Column:
    """Progress in percent; NULL of nothing."""
    return done / F.nullif(total, F.lit(0)) * 100


def jittered(seconds: Column, share: float = 0.1, least: float = 1.0) -> Column:
    """A waiting time, up to so large a share longer or shorter, and never less than ``least``."""
    return F.greatest(F.lit(least), seconds * (1 + (F.rand() * 2 - 1) * share))
