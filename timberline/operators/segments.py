"""Time-window segments: placement, statistics, reconciliation, overlap."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.timeframe import (
    parse_time,
    seconds_interval,
    segment_id,
    time_literal,
    width_seconds,
    window_start,
)
from timberline.schema import LogSchema

SEAL_GRACE = dt.timedelta(seconds=60)
# Bucket lengths of an overlap join: 64 s, then sixteen times as long up to more than all time.
_LEVEL_MICROS = tuple(min(64_000_000 * 16**k, 2**62) for k in range(10))
DEFAULT_LIST_LIMIT = 100


def with_segment(df: DataFrame, width: Any, schema: LogSchema = LogSchema(), name: str = "segment_id") -> DataFrame:
    schema = schema.bind(df)
    return df.withColumn(name, segment_id(window_start(F.col(schema.timestamp), width, schema.ntz)))


def placement(ts: Column, now: Any, width: Any, grace: dt.timedelta = SEAL_GRACE, ntz: bool = True) -> dict[str, Column]:
    """Where an event goes when it arrives at ``now``, one moment for all rows; see :func:`placement_at`."""
    return placement_at(ts, time_literal(now, ntz), width, grace, ntz)


def placement_at(
    ts: Column, now: Column, width: Any, grace: dt.timedelta = SEAL_GRACE, ntz: bool = True
) -> dict[str, Column]:
    """Where an event goes when it arrives at ``now``, a column of the type of ``ts``.

    An event's own window is open from its start until ``grace`` after its end.
    Events of closed (late) or not yet started (future) windows go to the
    current window and remember the window they were meant for.
    """
    start = window_start(ts, width, ntz)
    future = start > now
    late = (start + seconds_interval(width_seconds(width)) + F.lit(grace)) <= now
    own = segment_id(start)
    current = segment_id(window_start(now, width, ntz))
    return {
        "segment_id": F.when(future | late, current).otherwise(own),
        "placement": F.when(future, "future").when(late, "late").otherwise("on_time"),
        "intended_segment": F.when(future | late, own),
    }


def place_events(
    df: DataFrame, now: Any, width: Any, schema: LogSchema = LogSchema(), grace: dt.timedelta = SEAL_GRACE
) -> DataFrame:
    """Add ``segment_id``, ``placement`` and ``intended_segment``; works on streams."""
    schema = schema.bind(df)
    return df.withColumns(placement(F.col(schema.timestamp), now, width, grace, schema.ntz))


def segment_stats(
    df: DataFrame, segment: Column | str, schema: LogSchema = LogSchema(), sized: str | None = None
) -> DataFrame:
    """Rows, time bounds and sorted distinct sources per segment.

    ``sized`` names a text column whose total length becomes ``size_bytes``.
    """
    by = F.col(segment) if isinstance(segment, str) else segment
    ts = F.col(schema.timestamp)
    size = [F.sum(F.octet_length(sized)).cast("bigint").alias("size_bytes")] if sized else []
    return df.groupBy(by.alias("id")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("time_start"),
        F.max(ts).alias("time_end"),
        F.array_sort(F.collect_set(F.col(schema.source))).alias("sources"),
        *size,
    )


def window_stats(
    df: DataFrame, width: Any, schema: LogSchema = LogSchema(), sized: str | None = None
) -> DataFrame:
    """``segment_stats`` of the tumbling windows of ``width``.

    Rows are grouped by the window start; the id text is made per segment only.
    """
    schema = schema.bind(df)
    start = window_start(F.col(schema.timestamp), width, schema.ntz)
    return segment_stats(df, start, schema, sized).withColumn("id", segment_id(F.col("id")))


def empty_windows(stats: DataFrame, start: Any, end: Any, width: Any, ntz: bool = True) -> DataFrame:
    """Planned windows of ``[start, end)`` that no segment covers."""
    seconds = width_seconds(width)
    low, high = parse_time(start), parse_time(end)
    epoch = dt.datetime(1970, 1, 1)
    first = -(-int((low - epoch).total_seconds()) // seconds)
    last = -(-int((high - epoch).total_seconds()) // seconds)
    starts = F.timestamp_seconds(F.col("id") * F.lit(seconds))
    spine = stats.sparkSession.range(first, max(first, last)).select(
        segment_id(starts).alias("id"),
        (starts.cast("timestamp_ntz") if ntz else starts).alias("window_start"),
    )
    return spine.join(stats.select("id"), "id", "left_anti")


def sealable(segments: DataFrame, now: Any, width: Any, grace: dt.timedelta = SEAL_GRACE, ntz: bool = True) -> DataFrame:
    """Active segments whose window ended at least ``grace`` ago, oldest first."""
    from timberline.functions.timeframe import segment_start

    end = segment_start(F.col("id"), ntz) + seconds_interval(width_seconds(width))
    cutoff = time_literal(parse_time(now) - grace, ntz)
    return segments.filter((F.col("state") == "active") & (end <= cutoff)).orderBy("id")


def reconcile(active_files: DataFrame, sealed_files: DataFrame, catalog: DataFrame) -> DataFrame:
    """What a restart has to do per segment id, from the files found and the catalog.

    Inputs: ``id`` of active files, ``id`` of sealed files, ``id, state`` of the
    catalog. Output: ``id, has_active, has_sealed, state, action, orphan_active``.
    """
    active = active_files.select("id", F.lit(True).alias("_a"))
    sealed = sealed_files.select("id", F.lit(True).alias("_s"))
    known = catalog.select("id", F.col("state"))
    joined = active.join(sealed, "id", "full_outer").join(known, "id", "full_outer")
    has_active, has_sealed = F.coalesce("_a", F.lit(False)), F.coalesce("_s", F.lit(False))
    # A sealed file supersedes an active file of the same id.
    live = has_active & ~has_sealed
    state = F.col("state")
    action = (
        F.when(state.isNull() & has_sealed, "register_sealed")
        .when(state.isNull() & live, "register_active")
        .when((state == "active") & ~live, "mark_lost")
        .when((state == "sealed") & ~has_sealed, "mark_lost")
        .otherwise("keep")
    )
    return joined.select(
        "id",
        has_active.alias("has_active"),
        has_sealed.alias("has_sealed"),
        state,
        action.alias("action"),
        (has_active & has_sealed).alias("orphan_active"),
    )


def apply_reconcile(catalog: DataFrame, found: DataFrame, stats: DataFrame, now: Any) -> DataFrame:
    """The catalog after ``reconcile`` (``found``).

    Files the catalog does not know become rows with their statistics (``stats``: ``id, row_count,
    time_start, time_end, sources`` of the stored rows); segments whose file is gone are lost
    and have no local path any more. An id that is no window start is left out: such a file is not ours.
    Columns of the catalog that a new row cannot fill are null.
    """
    from timberline.functions.timeframe import segment_start

    ntz = str(catalog.schema["time_start"].dataType) == "TimestampNTZType()"
    actions = found.select(F.col("id").alias("_id"), "action")
    gone = F.coalesce(F.col("action") == "mark_lost", F.lit(False))
    changed = {"state": F.when(gone, "lost").otherwise(F.col("state"))}
    if "local_path" in catalog.columns:
        changed["local_path"] = F.when(~gone, F.col("local_path"))
    kept = catalog.join(actions, F.col("id") == F.col("_id"), "left").withColumns(changed).select(*catalog.columns)
    new = found.filter(F.col("action").isin("register_sealed", "register_active") & segment_start(F.col("id"), ntz).isNotNull())
    state = F.when(F.col("action") == "register_sealed", "sealed").otherwise("active")
    rows = new.select("id", state.alias("state"), F.col("action").alias("_action")).join(stats, "id", "left")
    if "sealed_at" in catalog.columns:
        rows = rows.withColumn("sealed_at", F.when(F.col("state") == "sealed", time_literal(now, ntz)))
    for field in catalog.schema.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return kept.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in catalog.schema.fields]))


def overlapping(segments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Segments that touch ``[start, end]``; lost ones hold no data."""
    return segments.filter(
        (F.col("state") != "lost") & (F.col("time_start") <= end) & (F.col("time_end") >= start)
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    bounds: tuple[str, str] = ("time_start", "time_end"),
    prefix: str = "right_",
) -> DataFrame:
    """Pairs of rows whose closed intervals intersect.

    Intervals have levels by their length, each with buckets sixteen times as long as the level
    below, from a minute to beyond the range of timestamps. On its own level and above an
    interval touches two buckets at most, so it is listed a few times, whether it lasts seconds
    or centuries. Two intervals meet on the level of the longer one, by equality on the bucket:
    a hash or sort-merge join that AQE can split when a bucket is hot, instead of a
    nested loop. A pair is kept in the bucket where the later interval starts.

    The rows of one bucket are compared with each other. That suits segments, of which
    few share a time; it is not meant for events.
    """
    lo, hi = bounds

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    def bucket(at: Column, width: Column) -> Column:
        return F.floor((at - F.pmod(at, width)) / width).cast("bigint")

    widths = F.array(*[F.lit(w).cast("bigint") for w in _LEVEL_MICROS])

    def spread(df: DataFrame) -> DataFrame:
        first, last = micros(F.col(lo)), micros(F.col(hi))
        own = reduce(add, [(last - first > F.lit(w)).cast("int") for w in _LEVEL_MICROS[:-1]])

        def places(level: Column) -> Column:
            width = F.element_at(widths, level + 1)
            one = F.struct(level.alias("level"), bucket(first, width).alias("bucket"))
            two = F.struct(level.alias("level"), bucket(last, width).alias("bucket"))
            return F.array_distinct(F.array(one, two))

        listed = F.flatten(F.transform(F.sequence(own, F.lit(len(_LEVEL_MICROS) - 1)), places))
        return df.filter(F.col(lo) <= F.col(hi)).withColumns({"_own": own, "_place": F.explode(listed)})

    a = spread(left)
    b = spread(right.select([F.col(c).alias(prefix + c) for c in right.columns]).withColumns(
        {lo: F.col(prefix + lo), hi: F.col(prefix + hi)}
    )).drop(lo, hi).withColumnRenamed("_own", "_other")
    later_start = micros(F.greatest(F.col(lo), F.col(prefix + lo)))
    level = F.greatest("_own", "_other")
    return (
        a.join(b, "_place")
        .filter(
            (F.col(lo) <= F.col(prefix + hi))
            & (F.col(prefix + lo) <= F.col(hi))
            & (F.col("_place.level") == level)
            & (F.col("_place.bucket") == bucket(later_start, F.element_at(widths, level + 1)))
        )
        .drop("_place", "_own", "_other")
    )


def list_segments(
    segments: DataFrame,
    states: Sequence[str] | None = None,
    start: Any = None,
    end: Any = None,
    source: str | None = None,
    limit: int = DEFAULT_LIST_LIMIT,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A page of the segment list, newest first, and its total."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    ntz = str(segments.schema["time_start"].dataType) == "TimestampNTZType()"
    kept = segments
    if states:
        kept = kept.filter(F.col("state").isin(list(states)))
    if start is not None:
        kept = kept.filter(F.col("time_end") >= time_literal(start, ntz))
    if end is not None:
        kept = kept.filter(F.col("time_start") <= time_literal(end, ntz))
    if source:
        kept = kept.filter(F.array_contains("sources", source))
    page = kept.orderBy(F.col("time_start").desc(), F.col("id").desc())
    if offset:
        page = page.offset(offset)
    return page.limit(limit), kept.agg(F.count(F.lit(1)).alias("total"))


def totals_by_state(segments: DataFrame) -> DataFrame:
    """Segments and bytes per state; the compressed size counts when known."""
    size = F.when(F.col("size_compressed") > 0, F.col("size_compressed")).otherwise(F.col("size_bytes"))
    return segments.groupBy("state").agg(F.count(F.lit(1)).alias("segments"), F.sum(size).alias("bytes"))
