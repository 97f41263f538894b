"""Calendar arithmetic and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display order of weekdays and months.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def date_key(day: Column) -> Column:
    """Calendar day as the integer yyyymmdd."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.day(day)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from ``start`` to ``end``, rounded down also below zero.

    A difference of dates would count midnights instead. Timestamps without time zone are
    subtracted as such, so no daylight saving time of the session gets in.
    """
    span = end - start
    toward_zero = F.extract(F.lit("DAY"), span)
    rest_below_zero = span < F.make_dt_interval(days=toward_zero)
    return (toward_zero - rest_below_zero.cast("int")).cast("bigint")


def months_between_starts(earlier: Column, later: Column) -> Column:
    """Number of month boundaries between two dates."""
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return months.cast("bigint")


def period_label(year: Column, month: Column) -> Column:
    """``YYYY-MM``."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def position_in(value: Column, ordered: tuple[str, ...]) -> Column:
    """1-based place of ``value`` in a fixed list, so that reports sort by meaning."""
    return F.array_position(F.array(*[F.lit(v) for v in ordered]), value).cast("int")
