"""The quoting window and rate dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.common import blank_to_null


def moment(text: Column) -> Column:
    return F.try_to_timestamp(blank_to_null(text))


def unreadable(text: Column) -> Column:
    """Set, but not a timestamp anything downstream could use."""
    return blank_to_null(text).isNotNull() & moment(text).isNull()


def window_days(starts: Column, ends: Column) -> Column:
    """Whole days between opening and closing, floored; NULL until both can be read."""
    return F.floor((F.unix_timestamp(moment(ends)) - F.unix_timestamp(moment(starts))) / 86400)


def stamp(text: Column) -> Column:
    """`9 Sep 2026, 17:00`; an unreadable text is returned as it is."""
    return F.coalesce(F.date_format(moment(text), "d MMM yyyy, HH:mm"), text, F.lit(""))


def window_check(days: Column) -> Column:
    return (
        F.when(days < 0, F.lit("closes before it opens"))
        .when(days < 5, F.lit("short window"))
        .when(days.isNotNull(), F.lit("ok"))
    )


def rate_age(as_of: Column, today: Column) -> Column:
    return F.datediff(today, as_of)


def rate_check(age: Column) -> Column:
    return F.when(age > 30, F.lit("stale")).when(age < 0, F.lit("forward")).otherwise(F.lit("current"))
