"""Windows that close: one row per window, once its end and the grace after it have passed on the stream."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.timeframe import segment_id, width_seconds
from timberline.operators.segments import SEAL_GRACE, placement_at
from timberline.schema import LogSchema

_SETTLED = "_settled"


def closed_windows(
    events: DataFrame,
    arrived: Column | str,
    width: Any,
    schema: LogSchema = LogSchema(),
    grace: dt.timedelta = SEAL_GRACE,
) -> DataFrame:
    """A stream of the windows that closed: ``id``, ``window_start``, ``window_end``, ``row_count``, ``late``, ``future``,
    ``time_start``, ``time_end`` and ``sources``; for an append sink.

    ``arrived`` tells when a row came in; a row without it is settled at its own time, one without a time at its arrival, one
    without both is in no window. Rows of closed and of future windows count in the window they arrived in, as ``place_events`` puts them, so the time a row is settled at is never behind what has closed, and none is
    lost. The watermark runs on that time, ``grace`` behind the latest arrival: a window is emitted when a row has arrived
    ``grace`` after its end, and not before. State is one row per open window. Rows that arrive out of order by more than
    the grace, that is from a source that replays an old arrival, are the only ones that the watermark leaves out.
    """
    schema = schema.bind(events)
    arrived = F.col(arrived) if isinstance(arrived, str) else arrived
    seconds = width_seconds(width)
    ts = F.col(schema.timestamp)
    now = arrived.cast("timestamp_ntz" if schema.ntz else "timestamp")
    placed = placement_at(ts, now, width, grace, schema.ntz)
    # In the window of its placement, and never ahead of its arrival.
    settled = F.when(placed["placement"] == "on_time", F.least(ts, now)).otherwise(now).cast("timestamp")
    rows = events.withColumns({_SETTLED: settled, "placement": placed["placement"]})
    windows = rows.withWatermark(_SETTLED, f"{int(grace.total_seconds())} seconds").groupBy(
        F.window(_SETTLED, f"{seconds} seconds").alias("window")
    )
    found = windows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("placement") == "late").alias("late"),
        F.count_if(F.col("placement") == "future").alias("future"),
        F.min(ts).alias("time_start"),
        F.max(ts).alias("time_end"),
        F.array_sort(F.collect_set(F.col(schema.source))).alias("sources"),
    )
    kind = "timestamp_ntz" if schema.ntz else "timestamp"
    start, end = F.col("window.start").cast(kind), F.col("window.end").cast(kind)
    return found.select(
        segment_id(start).alias("id"),
        start.alias("window_start"),
        end.alias("window_end"),
        *["row_count", "late", "future", "time_start", "time_end", "sources"],
    )
