"""Free-form date and time text to UTC instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.functions.text import let, strip

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _year(col: Column) -> Column:
    """Two-digit years: 00-68 are 20xx, the rest 19xx."""
    short = F.length(col) == 2
    century = F.when(col.try_cast("int") <= 68, "20").otherwise("19")
    return F.when(short, F.concat(century, col)).otherwise(col)


def _month(col: Column) -> Column:
    names = F.array(*[F.lit(m) for m in _MONTHS])
    return F.lpad(F.array_position(names, F.substring(F.lower(col), 1, 3)).cast("string"), 2, "0")


def parse_time(col: Column) -> Column:
    """UTC instant of RFC-822, ISO 8601, epoch or loosely written times, else null.

    The weekday is ignored (it may be wrong). Numeric offsets are honoured;
    zone names other than UTC and times without a zone count as UTC.
    """
    return let(F.lower(strip(col)), _instant)


def _instant(lower: Column) -> Column:
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    day_first = rf"(?:^|[\s,])(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+({_MONTH})\.?,?[\s-]+(\d{{4}}|\d{{2}})(?![\d:])"
    month_first = rf"({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,\s*|\s+(?:[\d:.]+\s+)?)(\d{{4}})(?!\d)"
    slashes = r"(?:^|\s)(\d{1,2})/(\d{1,2})/(\d{4})"
    compact = r"^(\d{4})(\d{2})(\d{2})t\d"

    def date_of(pattern, y, m, d, named=False):
        month = F.regexp_extract(lower, pattern, m)
        return F.concat_ws("-", _year(F.regexp_extract(lower, pattern, y)),
                           _month(month) if named else F.lpad(month, 2, "0"),
                           F.lpad(F.regexp_extract(lower, pattern, d), 2, "0"))

    swapped = F.regexp_extract(lower, slashes, 1).try_cast("int") > 12
    date = (F.when(lower.rlike(iso), date_of(iso, 1, 2, 3))
            .when(lower.rlike(compact), date_of(compact, 1, 2, 3))
            .when(lower.rlike(day_first), date_of(day_first, 3, 2, 1, True))
            .when(lower.rlike(month_first), date_of(month_first, 3, 1, 2, True))
            .when(lower.rlike(slashes), F.when(swapped, date_of(slashes, 3, 2, 1))
                  .otherwise(date_of(slashes, 3, 1, 2))))

    clock = r"(?:^|[\st])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(am|pm)?"
    packed = r"t(\d{2})(\d{2})(\d{2})?(?:[z+-]|$)"
    hour = F.regexp_extract(lower, clock, 1).try_cast("int")
    half = F.regexp_extract(lower, clock, 5)
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    second = F.nullif(F.regexp_extract(lower, clock, 3), F.lit(""))
    fraction = F.nullif(F.regexp_extract(lower, clock, 4), F.lit(""))
    time = (F.when(lower.rlike(clock), F.concat(
                F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(lower, clock, 2), F.lit(":"),
                F.coalesce(second, F.lit("00")), F.coalesce(F.concat(F.lit("."), fraction), F.lit(""))))
            .when(lower.rlike(packed), F.concat(
                F.regexp_extract(lower, packed, 1), F.lit(":"), F.regexp_extract(lower, packed, 2), F.lit(":"),
                F.coalesce(F.nullif(F.regexp_extract(lower, packed, 3), F.lit("")), F.lit("00"))))
            .otherwise(F.lit("00:00:00")))
    offset = r"(?::\d{2}(?:[.,]\d+)?|t\d{4}(?:\d{2})?)\s*(?:am|pm|[a-z]{2,4})?\s*([+-]\d{2}):?(\d{2})?(?!\d)"
    zone = F.when(lower.rlike(offset), F.concat(
        F.regexp_extract(lower, offset, 1), F.lit(":"),
        F.coalesce(F.nullif(F.regexp_extract(lower, offset, 2), F.lit("")), F.lit("00")))).otherwise(F.lit("+00:00"))
    seconds = F.when(lower.rlike(r"^\d{1,12}$"), lower.try_cast("bigint"))
    return (F.when(seconds == 0, F.lit(None).cast("timestamp"))
            .when(seconds.isNotNull(), F.timestamp_seconds(seconds))
            .otherwise(F.concat(date, F.lit(" "), time, zone).try_cast("timestamp")))


def utc_format(col: Column, pattern: str) -> Column:
    """Format an instant in UTC, whatever the session's zone."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), col.cast("timestamp_ntz")), pattern)
