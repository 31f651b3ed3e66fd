"""Group keys from dates and times at fixed offsets from UTC, without daylight saving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

# Zones and their offsets in hours.
ZONES = {
    "UTC": 0,
    "America/New_York": -5,
    "America/Chicago": -6,
    "America/Denver": -7,
    "America/Los_Angeles": -8,
    "America/Sao_Paulo": -3,
    "America/Buenos_Aires": -3,
    "Europe/London": 0,
    "Europe/Paris": 1,
    "Europe/Berlin": 1,
    "Europe/Moscow": 3,
    "Asia/Dubai": 4,
    "Asia/Kolkata": 5.5,
    "Asia/Shanghai": 8,
    "Asia/Tokyo": 9,
    "Australia/Sydney": 10,
    "Pacific/Auckland": 12,
}
#: Characters of YYYY-MM-DDTHH:MM that each granularity keeps.
LENGTHS = {"year": 4, "month": 7, "day": 10, "hour": 13, "minute": 16}


def date_key(column: Column, kind: DataType, granularity: str, offset_hours: float) -> Column:
    """A text key like 2024-01 or 2024-01-15T10; the session's time zone has no part in it."""
    if isinstance(kind, TimestampType):
        column = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
    else:
        column = column.cast("timestamp_ntz")
    if minutes := round(offset_hours * 60):
        column = column + F.expr(f"INTERVAL '{minutes}' MINUTE")
    return F.translate(F.substring(column.cast("string"), 1, LENGTHS[granularity]), " ", "T")
