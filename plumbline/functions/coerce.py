"""Values of a filter in the type of their column."""

from __future__ import annotations

from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

#: Operators whose value means nothing.
UNTYPED = ("is_null", "is_not_null")


def _parsed(text: str) -> datetime | None:
    text = text.strip()
    try:
        return datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    except ValueError:
        return None


def _moment(value: Any, zoned: bool) -> Any:
    """A literal; with a zone in UTC, without one as UTC is meant. What is no date and time stays as it is."""
    at = value if isinstance(value, datetime) else _parsed(value) if isinstance(value, str) else None
    if at is None:
        return value
    if zoned:
        at = at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)
        return F.lit(at.isoformat(sep=" ")).cast("timestamp")
    at = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def _day(value: Any) -> Any:
    if isinstance(value, datetime):
        value = value.date()
    elif isinstance(value, str):
        at = _parsed(value)
        value = at.date() if at else value
    return F.lit(value) if isinstance(value, date) else value


def _single(kind: DataType, value: Any) -> Any:
    if isinstance(value, dict) and set(value) == {"$date"}:
        value = value["$date"]
    if isinstance(kind, TimestampNTZType | TimestampType):
        return _moment(value, isinstance(kind, TimestampType))
    return _day(value) if isinstance(kind, DateType) else value


def coerce(kind: DataType, operator: str, value: Any) -> Any:
    """Lists item by item; None, other types and text that is no date stay as they are."""
    if operator in UNTYPED or value is None:
        return value
    if isinstance(value, list | tuple | set):
        return type(value)(_single(kind, x) for x in value)
    return _single(kind, value)
