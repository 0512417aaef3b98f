"""Calendar expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Sunday first.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def month_of(ts: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.to_date(ts), "month")


def quarter_of(ts: Column) -> Column:
    """First day of the quarter, as DATE."""
    return F.trunc(F.to_date(ts), "quarter")


def weekday_sunday0(ts: Column) -> Column:
    return F.dayofweek(F.to_date(ts)) - 1


def day_name(weekday: Column) -> Column:
    """Name of a weekday counted from Sunday = 0."""
    # element_at answers with some element for a NULL position, hence the test.
    names = F.array(*[F.lit(name) for name in DAY_NAMES])
    return F.when(weekday.isNotNull(), F.element_at(names, weekday + 1))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods between two timestamps."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(86_400_000_000))


def utc_instant(ts: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session zone."""
    return F.make_timestamp(
        F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts),
        F.extract(F.lit("SECOND"), ts), F.lit("UTC"),
    )


def utc_day(instant: Column) -> Column:
    """The UTC calendar day of an instant, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86_400).cast("int"))
