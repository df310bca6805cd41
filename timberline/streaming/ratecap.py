"""Rate cap on a stream: at most ``cap`` events per subscription and window, counted in keyed state.

The state of a (subscription, window) is one number and ends by a timer at the window's end, once the watermark
has passed it, so the store holds the open windows alone and a batch costs the same whether it is the tenth or the millionth.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timberline.schema import LogSchema
from timberline.session import STATE_STORE
from timberline.streaming.live import RATE_CAP, RATE_WINDOW_SECONDS, rate_window

LATENESS = "10 minutes"
_TIME = "_event_time"
_KEYS = ["subscription", "window_start"]


def _thin(cap: int, order: list[str]):
    """The first ``cap`` rows of each window in every Arrow batch, so that a flood is cut before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows <= cap:
                yield batch
                continue
            table = pa.Table.from_batches([batch]).select([*_KEYS, *order])
            at = pc.sort_indices(table, [(c, "ascending") for c in [*_KEYS, *order]], null_placement="at_start").to_numpy()
            codes = [pc.dictionary_encode(batch.column(c), "encode").indices.to_numpy(zero_copy_only=False)[at] for c in _KEYS]
            new = np.ones(len(at), bool)
            new[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
            starts = np.flatnonzero(new)
            place = np.arange(len(at)) - starts[np.cumsum(new) - 1]
            kept = np.sort(at[place < cap])
            yield batch if len(kept) == batch.num_rows else batch.take(pa.array(kept))

    return run


class _Cap(StatefulProcessor):
    """Lets the first rows of a window pass and remembers how many did."""

    def __init__(self, cap: int, seconds: int, order: list[str], names: list[str]):
        self.cap, self.seconds, self.order, self.names = cap, seconds, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "n bigint")

    def _place(self, row: Row) -> tuple:
        return tuple(part for c in self.order for part in ((False, 0) if row[c] is None else (True, row[c])))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.passed.get()
        passed = known[0] if known else 0
        first = heapq.nsmallest(self.cap - passed, rows, key=self._place) if passed < self.cap else []
        if known is None and key[1] is not None:
            ends = key[1].replace(tzinfo=dt.timezone.utc) if key[1].tzinfo is None else key[1]
            self.handle.registerTimer(int(ends.timestamp() + self.seconds) * 1000)
        if known is None or first:
            self.passed.update((passed + len(first),))
        for row in first:
            yield Row(*self.names)(*[row[c] for c in self.names])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.passed.clear()
        return iter(())


def cap_rate_stream(
    matched: DataFrame,
    cap: int = RATE_CAP,
    seconds: int = RATE_WINDOW_SECONDS,
    schema: LogSchema = LogSchema(),
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming form of ``cap_rate`` over ``fan_out`` output: the rows that pass, with ``window_start``, as a stream.

    Rows of a micro-batch pass in (time, id) order behind those of earlier batches. A window is over once a row has come that is
    ``lateness`` newer than its end; what still comes for it does not pass. Rows without a time share one window that
    never ends. The sink's exactly-once write and the checkpoint of the state together survive a restart. The session
    keeps state in RocksDB (``prepare`` sets it).
    """
    spark = matched.sparkSession
    name, provider = STATE_STORE
    if spark.conf.get(name, None) != provider:
        raise RuntimeError(f"{name} must be {provider}: use build_session or prepare")
    schema = schema.bind(matched)
    order = [c for c in (schema.timestamp, schema.id) if c]
    flagged = matched.withColumn("window_start", rate_window(schema, seconds))
    thinned = flagged.mapInArrow(_thin(cap, order), flagged.schema)
    timed = thinned.withColumn(_TIME, F.col(schema.timestamp).cast("timestamp")).withWatermark(_TIME, lateness)
    return timed.groupBy(*_KEYS).transformWithState(
        _Cap(cap, seconds, order, flagged.columns), outputStructType=flagged.schema, outputMode="append", timeMode="eventTime"
    )

