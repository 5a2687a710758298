"""Times as numbers, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def millis(ts: str) -> Column:
    return F.floor(micros(ts) / 1000)


def seconds(ts: str) -> Column:
    return micros(ts) / F.lit(1e6)
