"""Julian days and calendar text, in Column expressions.

Dates before 1582-10-15 are read in the Julian calendar, as astronomers count; there is no
year 0 (year -1 comes before year 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Fixed value: Julian day of 1970-01-01 00:00 UTC.
UNIX_EPOCH_JD = 2440587.5


def julian_day(ts: Column) -> Column:
    """Julian day of a timestamp (UTC), as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 8.64e10 + UNIX_EPOCH_JD


def timestamp_of(jd: Column) -> Column:
    """Timestamp of a Julian day, to the microsecond."""
    return F.timestamp_micros(F.round((jd - UNIX_EPOCH_JD) * 8.64e10).cast("long"))


def julian_day_of(year: Column, month: Column, day: Column, hour: Column | float = 12.0, minute: Column | float = 0.0, second: Column | float = 0.0) -> Column:
    """Julian day of a calendar date; without a time of day noon is meant."""
    y = F.when(year < 0, year + 1).otherwise(year)
    early = F.when(month <= 2, 1).otherwise(0)
    yy, mm = y + 4800 - early, month + 12 * early - 3
    base = day + F.floor((153 * mm + 2) / 5) + 365 * yy + F.floor(yy / 4)
    gregorian = (year * 10000 + month * 100 + day) >= 15821015
    number = F.when(gregorian, base - F.floor(yy / 100) + F.floor(yy / 400) - 32045).otherwise(base - 32083)
    part = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return number - 0.5 + part(hour) / 24 + part(minute) / 1440 + part(second) / 86400


def calendar_of(jd: Column) -> Column:
    """struct(year, month, day) of a Julian day."""
    number = F.floor(jd + 0.5)
    alpha = F.floor((number - 1867216.25) / 36524.25)
    a = F.when(number < 2299161, number).otherwise(number + 1 + alpha - F.floor(alpha / 4))
    b = a + 1524
    c = F.floor((b - 122.1) / 365.25)
    d = F.floor(365.25 * c)
    e = F.floor((b - d) / 30.6001)
    month = F.when(e < 14, e - 1).otherwise(e - 13)
    year = F.when(month > 2, c - 4716).otherwise(c - 4715)
    return F.struct(F.when(year <= 0, year - 1).otherwise(year).cast("int").alias("year"), month.cast("int").alias("month"), (b - d - F.floor(30.6001 * e)).cast("int").alias("day"))


def day_of_week(jd: Column) -> Column:
    """0 is Sunday."""
    return (F.floor(jd + 1.5) % 7).cast("int")


# Layouts tried in turn, ISO, European, American.
LAYOUTS = ("yyyy-M-d[ H:m[:s]]", "d.M.yyyy[ H:m[:s]]", "M/d/yyyy[ H:m[:s]]")


SHORT_YEAR = r"^(\d{1,2})([./])(\d{1,2})[./](\d{2})(?=\s|$)(.*)$"


def parsed_date(text: Column, hint: str | None = None, wrap: int = 1950) -> Column:
    """Julian day of calendar text by ``hint`` first, then ISO, European and American order; null if none fits.

    A year of two digits, last in European or American order, lies in the hundred years from ``wrap`` on.
    """
    layouts = ([hint] if hint else []) + list(LAYOUTS)
    given = F.trim(text)
    part = lambda k: F.regexp_extract(given, SHORT_YEAR, k)
    year = full_year(part(4).try_cast("int"), wrap).cast("string")
    clean = F.when(given.rlike(SHORT_YEAR), F.concat(part(1), part(2), part(3), part(2), year, part(5))).otherwise(given)
    return F.coalesce(*(julian_day(F.try_to_timestamp(clean, F.lit(layout))) for layout in layouts))


def full_year(year: Column, wrap: int = 1950) -> Column:
    """Two-digit years in the hundred years from ``wrap`` on; other years stay."""
    century = wrap - wrap % 100
    near = year + century
    return F.when((year >= 0) & (year < 100), F.when(near < wrap, near + 100).otherwise(near)).otherwise(year)


def utc_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time of ``df``; one without a zone means UTC, whatever the session's zone."""
    c = F.col(column)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(df.schema[column].dataType, TimestampNTZType) and zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        seconds = F.unix_date(F.to_date(c)) * F.lit(86400).cast("long") + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))
