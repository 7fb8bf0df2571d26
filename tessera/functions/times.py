"""Times as ISO 8601 strings, and whole seconds between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(time: Column) -> Column:
    """To the second, as the clock of the time or the session's zone shows it."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def now() -> Column:
    """The time at which a query began, in UTC."""
    return F.concat(iso(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())), F.lit("+00:00"))


def seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", start, end)
