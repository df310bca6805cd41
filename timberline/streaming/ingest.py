"""Continuous ingest, window close statistics and stream sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.functions.timeframe import segment_id, time_literal, window_start
from timberline.operators.segments import SEAL_GRACE, place_events, segment_stats
from timberline.schema import LogSchema
from timberline.sources.extract import DEFAULT_MAPPING, extract
from timberline.sources.ndjson import accept_skip
from timberline.streaming.deltas import BATCH, TRIGGER, each_batch, finish, read_batches, write_batch


def stream_events(
    lines: DataFrame,
    mapping: Mapping[str, Sequence[str]] = DEFAULT_MAPPING,
    source: str | Column = "default",
    ingest_time: Any = None,
    **options: Any,
) -> DataFrame:
    """Events of a stream of lines. Without ``ingest_time`` the trigger time is used."""
    arrived = F.current_timestamp() if ingest_time is None else ingest_time
    return extract(lines, mapping, source, arrived, **options)


def append_store(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: Any = "1h",
    schema: LogSchema = LogSchema(),
    available_now: bool = False,
    trigger: str = TRIGGER,
    writers: int | None = None,
) -> StreamingQuery:
    """Append events to a store laid out like the sealed one (day, segment).

    Every task writes its own file per segment and batch. With ``writers`` a batch is
    first shuffled so that a segment gets at most that many files; the rows of a
    hot segment still spread over as many tasks. ``compact`` merges the files of many batches.

    The files of a batch lie in folders named by its number, which are replaced when the
    batch is repeated: a restart after a lost driver or executor neither loses nor repeats rows.
    One store belongs to one checkpoint, which numbers its batches.
    Events are stored by their own time: a late one is found by a query of its time at
    once. ``seal_closed`` turns closed windows into sealed segments.
    """
    placed = _placed(events, width, schema.bind(events), writers)
    return each_batch(placed, lambda batch, number: _write_events(batch, path, number), checkpoint, available_now, trigger)


def _placed(events: DataFrame, width: Any, schema: LogSchema, writers: int | None) -> DataFrame:
    start = window_start(F.col(schema.timestamp), width, schema.ntz)
    placed = events.withColumns({"dt": F.to_date(start), "segment_id": segment_id(start)})
    if writers:
        share = F.pmod(F.xxhash64(schema.raw, schema.timestamp), F.lit(writers))
        placed = placed.repartition("dt", "segment_id", share)
    return placed


def _write_events(placed: DataFrame, path: str, number: int) -> None:
    (
        placed.withColumn(BATCH, F.lit(number))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("dt", "segment_id", BATCH)
        .parquet(path)
    )


LEDGER = "source string, accepted bigint, skipped bigint"


def _sum_ledger(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("accepted").alias("accepted"), F.sum("skipped").alias("skipped"))


def ingest(
    lines: DataFrame,
    path: str,
    ledger: str,
    checkpoint: str,
    mapping: Mapping[str, Sequence[str]] = DEFAULT_MAPPING,
    source: str | Column = "default",
    ingest_time: Any = None,
    width: Any = "1h",
    available_now: bool = False,
    trigger: str = TRIGGER,
    writers: int | None = None,
    **options: Any,
) -> StreamingQuery:
    """Lines of a stream into a store (``append_store``), and into a ledger how many of each source were accepted and skipped.

    A micro-batch writes its events and its row of the ledger under its own number, so a batch
    that is repeated counts once, and the ledger holds every batch however long the stream runs
    (``read_ledger``). Without ``ingest_time`` it is the batch's time, which a repeated batch takes over.
    """
    named = source if isinstance(source, Column) else F.lit(source)
    arrived = F.current_timestamp() if ingest_time is None else time_literal(ingest_time, False)
    # Both are set in the stream's own plan, where a repeated batch sees the same time.
    marked = lines.withColumns({"_source": named, "_arrived": arrived})

    def work(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            events = extract(batch, mapping, F.col("_source"), F.col("_arrived"), **options)
            schema = LogSchema(id=None).bind(events)
            _write_events(_placed(events, width, schema, writers), path, number)
            write_batch(accept_skip(batch, F.col("_source")), ledger, number, _sum_ledger)
        finally:
            batch.unpersist()

    return each_batch(marked, work, checkpoint, available_now, trigger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``source``, ``accepted`` and ``skipped`` of all batches so far."""
    return _sum_ledger(read_batches(spark, ledger, LEDGER))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Process what is available, append it to ``path`` and stop; raises after ``timeout`` seconds."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)


def mark_late(
    events: DataFrame, now: Any, width: Any, schema: LogSchema = LogSchema(), grace: dt.timedelta = SEAL_GRACE
) -> DataFrame:
    """Place each event at ``now``; nothing is dropped, late and future events are marked."""
    return place_events(events, now, width, schema, grace)


STATS = "id string, row_count bigint, time_start timestamp, time_end timestamp, sources array<string>"


def write_window_stats(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: Any,
    schema: LogSchema = LogSchema(),
    available_now: bool = False,
    trigger: str = TRIGGER,
) -> StreamingQuery:
    """Keep the statistics of all windows of a stream below ``path``.

    Every micro-batch adds the statistics of its own rows, late ones included, so the
    sum over the batches (``read_window_stats``) always equals the rows that came in.
    """
    schema = schema.bind(events)

    def work(batch: DataFrame, number: int) -> None:
        start = window_start(F.col(schema.timestamp), width, schema.ntz)
        stats = segment_stats(batch, start, schema).withColumn("id", segment_id(F.col("id")))
        instants = {c: F.col(c).cast("timestamp") for c in ("time_start", "time_end")}
        write_batch(stats.withColumns(instants), path, number, _sum_stats)

    return each_batch(events, work, checkpoint, available_now, trigger)


def _sum_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("id").agg(
        F.sum("row_count").alias("row_count"),
        F.min("time_start").alias("time_start"),
        F.max("time_end").alias("time_end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )


def read_window_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows, time bounds and sources of every window so far."""
    return _sum_stats(read_batches(spark, path, STATS))
