"""Time literals, relative ranges, tumbling windows and segment ids."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT_ID_FORMAT = "yyyyMMddHHmm"
DAY_SECONDS = 86_400

# Relative ranges a search may name.
PRESETS = {
    "15m": dt.timedelta(minutes=15),
    "1h": dt.timedelta(hours=1),
    "6h": dt.timedelta(hours=6),
    "24h": dt.timedelta(hours=24),
    "7d": dt.timedelta(days=7),
}


def parse_time(value: Any) -> dt.datetime:
    """Naive UTC datetime from a datetime or an ISO-8601 text (no offset means UTC)."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError as err:
            raise ValueError(f"not a timestamp: {value!r}") from err
    if not isinstance(value, dt.datetime):
        raise ValueError(f"not a timestamp: {value!r}")
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def time_literal(value: Any, ntz: bool = True) -> Column:
    """Typed constant that matches the time column, so no cast lands on the column."""
    text = parse_time(value).isoformat(sep=" ", timespec="microseconds")
    return F.lit(text).cast("timestamp_ntz") if ntz else F.lit(text + "Z").cast("timestamp")


def preset_range(
    name: str | None, now: Any, start: Any = None, end: Any = None
) -> tuple[dt.datetime, dt.datetime]:
    """Absolute range of a preset ending at ``now``; no name means the last hour."""
    if name == "custom":
        if start is None or end is None:
            raise ValueError("a custom range needs a start and an end")
        return parse_time(start), parse_time(end)
    if name and name not in PRESETS:
        raise ValueError(f"unknown time range {name!r}")
    upper = parse_time(now)
    return upper - PRESETS[name or "1h"], upper


def width_seconds(width: str | int | dt.timedelta) -> int:
    """Window width in seconds; a window is 5 minutes to 24 hours and divides a day."""
    if isinstance(width, dt.timedelta):
        seconds = int(width.total_seconds())
    elif isinstance(width, int):
        seconds = width
    else:
        match = re.fullmatch(r"([0-9]+)([mh])", width)
        if not match:
            raise ValueError(f"not a window width: {width!r}")
        seconds = int(match[1]) * (60 if match[2] == "m" else 3600)
    if not 300 <= seconds <= DAY_SECONDS or DAY_SECONDS % seconds:
        raise ValueError(f"window width {width!r} must divide a day and be 5m to 24h")
    return seconds


def window_start(ts: Column, width: str | int | dt.timedelta, ntz: bool = True) -> Column:
    """Start of the UTC tumbling window that holds ``ts``.

    Integer arithmetic on the epoch value: stays in generated code, keeps rows
    with a NULL time and, unlike ``F.window``, may be used many times per frame.
    """
    return floor_to(ts, width_seconds(width), ntz)


def floor_to(ts: Column, seconds: int, ntz: bool = True) -> Column:
    """``ts`` rounded down to a multiple of ``seconds`` since the epoch."""
    micros = F.unix_micros(ts.cast("timestamp"))
    step = seconds * 1_000_000
    start = F.timestamp_micros(micros - F.pmod(micros, F.lit(step)))
    return start.cast("timestamp_ntz") if ntz else start


def seconds_interval(seconds: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def segment_id(start: Column) -> Column:
    """Id of the segment whose window starts at ``start``."""
    return F.date_format(start, SEGMENT_ID_FORMAT)


def segment_start(segment: Column, ntz: bool = True) -> Column:
    """Inverse of ``segment_id``; NULL for text that is not an id."""
    ok = segment.rlike(r"^[0-9]{12}$")
    parsed = F.try_to_timestamp(F.when(ok, segment), F.lit(SEGMENT_ID_FORMAT))
    return parsed.cast("timestamp_ntz") if ntz else parsed


def iso_utc(ts: Column) -> Column:
    """RFC 3339 text in UTC with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
