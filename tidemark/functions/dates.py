"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(d: Column) -> Column:
    """20260420 for 2026-04-20."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def as_of(text: Column) -> Column:
    """The cut-off that a text means: a bare date is the end of its day."""
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T23:59:59.999999"))).otherwise(text)
    return F.try_to_timestamp(full).cast("timestamp_ntz")


def stored(text: Column) -> Column:
    """The moment that a stored text means: a bare date is midnight; an offset is refused (null)."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(text) > 10)
    return F.when(~zoned, F.try_to_timestamp(text).cast("timestamp_ntz"))


def age_days(now: Column, then: Column) -> Column:
    """Fractional days between two moments, in whole seconds."""
    seconds = F.unix_seconds(F.date_trunc("second", now).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", then).cast("timestamp"))
    return seconds / 86400.0


def days_to_close(expected: Column, today: Column) -> Column:
    """Calendar days, one at least."""
    return F.greatest(F.datediff(expected, today), F.lit(1))


def annualized(period: Column, days: Column) -> Column:
    """Simple, not compounded; null unless days is positive."""
    return F.when(days > 0, period * (365.0 / days))


def time_precision(text: Column) -> Column:
    """DATE_ONLY, INTRADAY or MISSING."""
    midnight = (F.length(text) == 10) | F.substring(text, 12, 8).isin("00:00:00", "00:00")
    return F.when(text.isNull() | (F.trim(text) == ""), "MISSING").when(midnight, "DATE_ONLY").otherwise("INTRADAY")


def known_at(explicit: Column, source: Column, ingested: Column) -> tuple[Column, Column]:
    """When a fact became known, and on which basis."""
    basis = F.when(explicit.isNotNull(), "explicit").when(source.isNotNull(), "source_timestamp").otherwise("ingestion")
    return F.coalesce(explicit, source, ingested), basis


def stamp(text: Column) -> Column:
    """A partial date (year to second) as value, precision, and the earliest and latest moment it can mean."""
    y, m, d = (F.regexp_extract(text, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", i) for i in (1, 2, 3))
    timed = F.regexp_extract(text, r"T(\d{2}:\d{2})(:\d{2})?", 1)
    seconds = F.regexp_extract(text, r"T\d{2}:\d{2}(:\d{2})", 1)
    precision = F.when(y == "", None).when(m == "", "year").when(d == "", "month").when(timed == "", "day").when(seconds == "", "minute").otherwise("second")
    first = F.concat(y, F.lit("-"), F.when(m == "", "01").otherwise(m), F.lit("-"), F.when(d == "", "01").otherwise(d))
    month_end = F.date_format(F.last_day(F.try_to_timestamp(first).cast("date")), "yyyy-MM-dd")
    last = F.when(m == "", F.concat(y, F.lit("-12-31"))).when(d == "", month_end).otherwise(first)
    lo = F.when(timed == "", F.lit("00:00:00")).otherwise(F.concat(timed, F.when(seconds == "", ":00").otherwise(seconds)))
    hi = F.when(timed == "", F.lit("23:59:59")).otherwise(F.concat(timed, F.when(seconds == "", ":59").otherwise(seconds)))
    at = lambda day, time: F.try_to_timestamp(F.concat(day, F.lit("T"), time)).cast("timestamp_ntz")
    return F.struct(text.alias("value"), precision.alias("precision"), at(first, lo).alias("earliest"), at(last, hi).alias("latest"))


def time_point(text: Column) -> Column:
    """A stamp's precision and the last UTC moment it can mean; a time of day without a zone is refused (precision ``refused``).

    Tokens for a missing value and null are null. A bare date is the end of its day.
    """
    plain = F.trim(text)
    missing = plain.isNull() | F.lower(plain).isin("", "n/d", "nd", "unknown", "none", "null")
    day = plain.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = F.regexp_replace(plain, " ", "T").rlike(r"T.*(Z|[+-]\d{2}:\d{2})$")
    end = F.try_to_timestamp(F.concat(plain, F.lit("T23:59:59.999999Z")))
    moment = F.when(day, end).when(zoned, F.try_to_timestamp(plain))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    precision = F.when(missing, None).when(moment.isNull(), "refused").when(day, "day").otherwise("second")
    return F.struct(precision.alias("precision"), F.when(~missing, utc).alias("latest_utc"))
