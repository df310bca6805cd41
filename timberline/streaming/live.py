"""Live filters over a stream, with the same predicates as a search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.functions import predicates as P
from timberline.functions.timeframe import floor_to
from timberline.schema import LogSchema
from timberline.streaming.deltas import each_batch, read_batches, write_batch

RATE_CAP = 100
RATE_WINDOW_SECONDS = 1


@dataclass(frozen=True)
class Subscription:
    """A named live filter; it must restrict something."""

    name: str
    where: P.Node | None = None
    text: str | list[str] | None = None

    def predicate(self, schema: LogSchema = LogSchema()) -> Column:
        cond = P.conjunction(P.compile_filter(self.where, schema), P.search_text(self.text, schema))
        if cond is None:
            raise ValueError(f"subscription {self.name!r} has neither a filter nor search text")
        return cond


def live_filter(events: DataFrame, sub: Subscription, schema: LogSchema = LogSchema()) -> DataFrame:
    return events.filter(sub.predicate(schema.bind(events)))


def fan_out(events: DataFrame, subs: list[Subscription], schema: LogSchema = LogSchema()) -> DataFrame:
    """One row per event and matching subscription, from one pass over the events."""
    schema = schema.bind(events)
    names = [s.name for s in subs]
    if not subs or len(set(names)) < len(names):
        raise ValueError("subscriptions need distinct names")
    hits = F.array_compact(F.array(*[F.when(s.predicate(schema), F.lit(s.name)) for s in subs]))
    return events.withColumn("subscription", F.explode(hits))


def rate_window(schema: LogSchema, seconds: int = RATE_WINDOW_SECONDS) -> Column:
    return floor_to(F.col(schema.timestamp), seconds, schema.ntz)


def cap_rate(
    matched: DataFrame, cap: int = RATE_CAP, seconds: int = RATE_WINDOW_SECONDS, schema: LogSchema = LogSchema()
) -> DataFrame:
    """First ``cap`` events per subscription and time window (batch form).

    Spark thins each task to its best ``cap`` rows per window before the
    shuffle, so a flood in one window does not reach one task.
    """
    schema = schema.bind(matched)
    flagged = matched.withColumn("window_start", rate_window(schema, seconds))
    place = Window.partitionBy("subscription", "window_start").orderBy(schema.timestamp, schema.id)
    return flagged.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= cap).drop("_n")


def drop_stats(
    matched: DataFrame, cap: int = RATE_CAP, seconds: int = RATE_WINDOW_SECONDS, schema: LogSchema = LogSchema()
) -> DataFrame:
    """Delivered and dropped events per subscription and time window.

    A partial aggregate: what is dropped follows from the count alone.
    """
    schema = schema.bind(matched)
    counts = matched.groupBy("subscription", rate_window(schema, seconds).alias("window_start")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counts.select("subscription", "window_start", *_split(cap))


def _split(cap: int) -> list[Column]:
    return [
        F.least(F.col("_n"), F.lit(cap)).cast("bigint").alias("delivered"),
        F.greatest(F.col("_n") - cap, F.lit(0)).cast("bigint").alias("dropped"),
    ]


MATCHES = "subscription string, window_start timestamp_ntz, n bigint"


def _sum_matches(counts: DataFrame) -> DataFrame:
    return counts.groupBy("subscription", "window_start").agg(F.sum("n").alias("n"))


def write_match_counts(
    matched: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int = RATE_WINDOW_SECONDS,
    schema: LogSchema = LogSchema(),
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the number of matched events per subscription and window of a stream below ``path``."""
    schema = schema.bind(matched)

    def work(batch: DataFrame, number: int) -> None:
        start = rate_window(schema, seconds).cast("timestamp_ntz").alias("window_start")
        write_batch(batch.groupBy("subscription", start).agg(F.count(F.lit(1)).alias("n")), path, number, _sum_matches)

    return each_batch(matched, work, checkpoint, available_now)


def read_drop_stats(spark: SparkSession, path: str, cap: int = RATE_CAP) -> DataFrame:
    """Streaming form of ``drop_stats``: delivered and dropped so far, late events included."""
    counts = _sum_matches(read_batches(spark, path, MATCHES)).withColumnRenamed("n", "_n")
    return counts.select("subscription", "window_start", *_split(cap))
