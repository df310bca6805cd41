"""Scans of a sealed store through its catalog: the catalog's rows decide which folders are read."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.timeframe import time_literal
from timberline.operators.segments import overlapping
from timberline.session import checkpointed
from timberline.sources.store import SEGMENT

SAMPLED = "_sampled"
# A catalog row is broadcast as an id of twelve digits and a flag: a few megabytes at most.
MOST_BROADCAST = 200_000


def readable_segments(catalog: DataFrame, start: Any, end: Any) -> DataFrame:
    """Segments whose own time bounds touch the range and whose rows are at hand: active ones and
    those with a local path, lost ones never. Without a range, all that are at hand."""
    if start is None:
        held = catalog.filter(F.col("state") != "lost")
    else:
        ntz = str(catalog.schema["time_start"].dataType) == "TimestampNTZType()"
        held = overlapping(catalog, time_literal(start, ntz), time_literal(end, ntz))
    if "local_path" in catalog.columns:
        held = held.filter((F.col("state") == "active") | F.col("local_path").isNotNull())
    return held


def newest_segments(segments: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` segments that start last, ties by id."""
    if sample <= 0:
        raise ValueError("sample must be positive")
    return segments.orderBy(F.col("time_start").desc(), F.col("id").desc()).limit(sample)


def catalog_scan(
    stored: DataFrame, catalog: DataFrame, start: Any = None, end: Any = None, newest: int | None = None, sample: int | None = None
) -> DataFrame:
    """The rows of a store (``read_store``) that lie in segments the catalog names for a time range.

    ``catalog`` has ``id, state, time_start, time_end`` and perhaps ``local_path``; its ids are distinct. The bounds are those of the rows a segment
    holds, so late rows are found in a segment whose window lies outside the range. ``newest`` keeps the segments that
    start last alone; ``sample`` adds a flag ``_sampled`` that is true for so many of them. Rows are not yet bounded
    by the range: filter them as for any table.

    The folders read follow from a join on the partition column, which Spark turns into partition pruning
    while the query runs, as long as the segments chosen are few enough to broadcast (``MOST_BROADCAST``, counted
    first). Beyond that, and it is decades of hourly segments, the join is left to Spark.
    """
    chosen = readable_segments(catalog, start, end)
    if newest is not None:
        chosen = newest_segments(chosen, newest)
    ids = chosen.select(F.col("id").alias("_id"))
    if sample is not None:
        flags = newest_segments(readable_segments(catalog, start, end), sample).select(F.col("id").alias("_id"), F.lit(True).alias(SAMPLED))
        ids = ids.join(flags, "_id", "left").select("_id", F.coalesce(SAMPLED, F.lit(False)).alias(SAMPLED))
    # Frozen, since Spark does not prune by a cached table; and it prunes by a filtered table alone.
    ids = checkpointed(ids).filter(F.col("_id") > "")
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    return stored.join(ids, F.col(SEGMENT) == F.col("_id"), "left_semi" if sample is None else "inner").drop("_id")
