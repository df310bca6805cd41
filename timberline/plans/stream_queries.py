"""Streaming queries: each runs over all available input, then reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.plans import extract_queries as EQ
from timberline.plans import segment_queries as SQ
from timberline.plans import tables as T
from timberline.plans.filters import error_of
from timberline.plans.storage_queries import _written_lines
from timberline.plans.tables import Case
from timberline.schema import LogSchema
from timberline.session import hadoop_path, scratch_path
from timberline.sources.compaction import compact, vacuum
from timberline.sources.ndjson import stream_lines
from timberline.sources.store import read_store, seal_closed
from timberline.streaming import ingest as I
from timberline.streaming import live as V
from timberline.streaming import windows as W
from timberline.streaming.deltas import finish, read_batches
from timberline.streaming.ratecap import cap_rate_stream

CAP = 3
WINDOW = 3600


def subscriptions() -> list[V.Subscription]:
    return [
        V.Subscription("errors", where=P.leaf("level", "eq", "error")),
        V.Subscription("web", where=P.all_of(P.leaf("service", "eq", "web"), P.leaf("attributes.k", "gt", 20))),
        V.Subscription("clicks", text="Click by"),
    ]


_MATCHED = """matched AS (
  SELECT 'errors' AS subscription, * FROM logs WHERE level = 'error' UNION ALL
  SELECT 'web', * FROM logs WHERE lower(service) = 'web' AND CAST(json_extract_string(attributes, '$.k') AS DOUBLE) > 20
  UNION ALL SELECT 'clicks', * FROM logs WHERE contains(lower(message), 'click by') OR contains(lower(raw), 'click by'))"""


def _logs(spark, sf):
    return T.as_logs(T.table_stream(spark, sf, "events"))


def _drain(stream):
    """Append everything the stream has to a fresh folder and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    I.run_to_parquet(stream, path, scratch_path(spark, "offsets"))
    return spark.read.schema(stream.schema).parquet(path)


def _scrambled(spark, sf):
    """The events as a stream of three micro-batches, the newest events in the first one."""
    events = T.table(spark, sf, "events")
    low, high = (r.timestamp() for r in events.agg(F.min("ts"), F.max("ts")).first())
    part = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - low) * 3 / (high - low + 1))
    part = F.least(F.greatest(part, F.lit(0)), F.lit(2))
    path = scratch_path(spark, "scrambled")
    for number in (2, 0, 1):
        events.filter(part == number).coalesce(1).write.mode("append").parquet(path)
    return T.as_logs(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))


def _hot(spark, sf):
    """A hot store filled by a stream of lines."""
    lines = stream_lines(spark, _written_lines(spark, sf))
    events = I.stream_events(lines, source="app", ingest_time=T.INGEST_TIME)
    path = scratch_path(spark, "store")
    finish(I.append_store(events, path, scratch_path(spark, "offsets"), "6h", available_now=True))
    return path


_STORED = ["service", "level", "message", "host", "source", "attributes", "raw", "segment_id"]


def _ingest(spark, sf):
    stored = read_store(spark, _hot(spark, sf))
    return stored.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *_STORED).withColumn(
        "attributes", EQ.entries_text("attributes")
    )


def _seal_closed(spark, sf):
    """Closed windows of a hot store sealed, twice; what is where afterwards."""
    hot, sealed = _hot(spark, sf), scratch_path(spark, "sealed")
    schema = LogSchema(id=None, ntz=False)
    for _ in range(2):
        seal_closed(spark, hot, sealed, "2024-01-20T06:00:30Z", "6h", schema)
    both = read_store(spark, hot).select("segment_id", F.lit("hot").alias("place")).unionAll(
        read_store(spark, sealed).select("segment_id", F.lit("sealed"))
    )
    return both.groupBy("segment_id", "place").agg(F.count(F.lit(1)).alias("n"))


def _compacted(spark, sf):
    """A hot store of six batches, compacted while one more arrives, after a compaction that was killed."""
    path, lines, offsets = (scratch_path(spark, n) for n in ("store", "batches", "offsets"))

    def arrive(rows):
        rows.write.mode("append").text(lines)
        events = I.stream_events(stream_lines(spark, lines, max_files=1), source="app", ingest_time=T.INGEST_TIME)
        finish(I.append_store(events, path, offsets, "24h", available_now=True, writers=1))

    every = T.ndjson(spark, sf)
    arrive(every.filter("event_id % 7 < 6").select("value").repartition(6, F.rand(2)))
    compact(spark, path)
    files, commits = hadoop_path(spark, f"{path}-commits")
    files.delete(commits, True)  # as if it had been killed before its commit
    compact(spark, path)
    arrive(every.filter("event_id % 7 = 6").select("value").coalesce(1))
    vacuum(spark, path)
    stored = read_store(spark, path).withColumn("_file", F.col("_metadata.file_path"))
    return stored.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("_file") <= 3).alias("few_files"))


def _taken_in(spark, sf, name, **bound):
    """Lines of two sources in six files, taken in batch by batch: the ledger's folder and its sums."""
    path, ledger = scratch_path(spark, name), scratch_path(spark, "ledger")
    kind = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    rows = T.ndjson(spark, sf).select("value", kind.alias("source")).repartition(3, F.rand(1))
    rows.write.partitionBy("source").text(path)
    lines = stream_lines(spark, path, folder="source", **bound)
    finish(I.ingest(lines, scratch_path(spark, "store"), ledger, scratch_path(spark, "offsets"), source=F.col("source"), ingest_time=T.INGEST_TIME, width="24h", available_now=True))
    return ledger, I.read_ledger(spark, ledger)


def _intake(spark, sf):
    """Lines accepted and skipped per source, from the ledger of a stream in batches of bounded bytes."""
    return _taken_in(spark, sf, "lines", max_bytes=400_000)[1]


def _bounded(spark, sf):
    """What a stream that takes one file a batch writes into its ledger, batch by batch."""
    ledger, _ = _taken_in(spark, sf, "bounded", max_files=1)
    rows = read_batches(spark, ledger, I.LEDGER)
    return rows.groupBy("source").agg(
        F.countDistinct("_batch").alias("batches"), F.sum(F.col("accepted") + F.col("skipped")).alias("lines"),
        (F.max(F.col("accepted") + F.col("skipped")) < 0.5 * F.sum(F.col("accepted") + F.col("skipped"))).alias("bounded"),
    )


def _filter(spark, sf):
    sub = V.Subscription(
        "live", where=P.all_of(P.leaf("level", "in", ["error", "warn"]), P.none_of(P.leaf("service", "eq", "api"))), text="user 1"
    )
    return _drain(V.live_filter(_logs(spark, sf), sub)).select("event_id", "level", "service", "message")


def _multi(spark, sf):
    return _drain(V.fan_out(_logs(spark, sf), subscriptions())).select("subscription", "event_id", "timestamp")


def in_batches(events, column, batches, path, files=1):
    """``events`` as a stream of ``batches`` micro-batches, one after the other by ``column``, of equal spans of time."""
    spark = events.sparkSession
    at = F.unix_timestamp(F.col(column).cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    part = F.least(F.greatest(F.floor((at - low) * batches / (high - low + 1)), F.lit(0)), F.lit(batches - 1))
    frozen = events.withColumn("_part", part)
    for number in range(batches):
        frozen.filter(F.col("_part") == number).drop("_part").coalesce(files).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def _rate_cap(spark, sf):
    """The logs in three micro-batches; a window's count lives on from one into the next."""
    events = in_batches(T.table(spark, sf, "events"), "ts", 3, scratch_path(spark, "in-order"))
    capped = cap_rate_stream(V.fan_out(T.as_logs(events), subscriptions()), CAP, WINDOW)
    return _drain(capped).select("subscription", "window_start", "event_id", "timestamp")


def _rate_cap_batch(spark, sf):
    matched = V.fan_out(T.logs(spark, sf), subscriptions())
    return V.cap_rate(matched, CAP, WINDOW).select("subscription", "window_start", "event_id", "timestamp")


def _unrestricted(spark, sf):
    """Subscriptions with search text made of an event type, or of blanks, which is refused."""
    kinds = T.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for (name,) in kinds.select("name").orderBy("name").collect():  # a handful
        for text in (name, "  "):
            sub = V.Subscription(name, text=text)
            rows.append((name, text, error_of(lambda sub=sub: sub.predicate(T.LOG_SCHEMA))))
    return spark.createDataFrame(rows, "name string, text string, error string").join(kinds, "name")


def _drop_batch(spark, sf):
    return V.drop_stats(V.fan_out(T.logs(spark, sf), subscriptions()), CAP, WINDOW)


def _drop_stream(spark, sf):
    matched = V.fan_out(_scrambled(spark, sf), subscriptions())
    path = scratch_path(spark, "matches")
    finish(V.write_match_counts(matched, path, scratch_path(spark, "offsets"), WINDOW, available_now=True))
    return V.read_drop_stats(spark, path, CAP)


def _seal_stats(spark, sf):
    path = scratch_path(spark, "window-stats")
    schema = LogSchema(source="service")
    finish(I.write_window_stats(_scrambled(spark, sf), path, scratch_path(spark, "offsets"), "6h", schema, available_now=True))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end")}
    return I.read_window_stats(spark, path).withColumns(times).withColumn("sources", F.array_join("sources", ","))


def _window_close(spark, sf):
    """Windows that closed while the events arrived in eight micro-batches."""
    stream = in_batches(T.arriving(spark, sf), "arrived", 8, scratch_path(spark, "arriving"))
    events = T.as_logs(stream, "arrived")
    closed = _drain(W.closed_windows(events, "arrived", T.WIDTH, LogSchema(source="service")))
    return closed.withColumn("sources", F.array_join("sources", ","))


def _late(spark, sf):
    placed = I.mark_late(_logs(spark, sf), "2024-01-20T06:00:30Z", T.WIDTH)
    return _drain(placed).select("event_id", "segment_id", "placement", "intended_segment")


_CAPPED = T.with_ctes(
    "SELECT subscription, window_start, event_id, timestamp FROM (SELECT *, time_bucket(INTERVAL '1 hour', timestamp) AS "
    "window_start, row_number() OVER (PARTITION BY subscription, time_bucket(INTERVAL '1 hour', timestamp) ORDER BY "
    f"timestamp, event_id) AS n FROM matched) WHERE n <= {CAP}",
    T.LOGS,
    _MATCHED,
)
_DROPPED = (
    "SELECT subscription, time_bucket(INTERVAL '1 hour', timestamp) AS window_start, "
    f"least(count(*), {CAP}) AS delivered, greatest(count(*) - {CAP}, 0) AS dropped FROM matched GROUP BY 1, 2"
)
CASES = [
    Case(
        "str_ingest",
        _ingest,
        T.with_ctes(
            f"SELECT coalesce(f_ts, TIMESTAMP '2024-02-01') AS timestamp, f_service AS service, {EQ._LEVEL} AS level, "
            f"nullif(f_message, '') AS message, f_host AS host, 'app' AS source, {EQ.ATTRIBUTES} AS attributes, line AS raw, "
            "strftime(time_bucket(INTERVAL '6 hours', coalesce(f_ts, TIMESTAMP '2024-02-01')), '%Y%m%d%H%M') AS segment_id FROM fields",
            *EQ._CTES,
            EQ.ATTRS,
        ),
    ),
    Case(
        "str_filter",
        _filter,
        T.with_ctes(
            "SELECT event_id, level, service, message FROM logs WHERE level IN ('error', 'warn') AND "
            "NOT (lower(service) = 'api') AND (contains(lower(message), 'user 1') OR contains(lower(raw), 'user 1'))",
            T.LOGS,
        ),
    ),
    Case(
        "str_multi_sub",
        _multi,
        T.with_ctes("SELECT subscription, event_id, timestamp FROM matched", T.LOGS, _MATCHED),
    ),
    Case(
        "str_subscription_errors",
        _unrestricted,
        "SELECT name, name AS text, '' AS error, n FROM (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1) UNION ALL "
        "SELECT name, '  ', concat('subscription ''', name, ''' has neither a filter nor search text'), n FROM "
        "(SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1)",
    ),
    Case("str_rate_cap", _rate_cap, _CAPPED),
    Case("str_rate_cap_batch", _rate_cap_batch, _CAPPED),
    Case("str_drop_stats", _drop_batch, T.with_ctes(_DROPPED, T.LOGS, _MATCHED)),
    Case("str_drop_stats_live", _drop_stream, T.with_ctes(_DROPPED, T.LOGS, _MATCHED)),
    Case(
        "str_seal_stats",
        _seal_stats,
        T.with_ctes(
            "SELECT strftime(time_bucket(INTERVAL '6 hours', timestamp), '%Y%m%d%H%M') AS id, count(*) AS row_count, "
            "min(timestamp) AS time_start, max(timestamp) AS time_end, coalesce(string_agg(DISTINCT service, ',' "
            "ORDER BY service), '') AS sources FROM logs GROUP BY 1",
            T.LOGS,
        ),
    ),
    Case(
        "str_intake",
        _intake,
        T.with_ctes(
            "SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) FILTER (event_id IN (SELECT event_id FROM docs)) "
            "AS accepted, count(*) FILTER (event_id NOT IN (SELECT event_id FROM docs)) AS skipped FROM lines GROUP BY 1",
            T.NDJSON,
            T.LINES,
            T.DOCS,
        ),
    ),
    Case(
        "str_bounded",
        _bounded,
        T.with_ctes(
            "SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, 3 AS batches, count(*) AS lines, true AS bounded "
            "FROM lines GROUP BY 1",
            T.NDJSON,
            T.LINES,
        ),
    ),
    Case(
        "snk_seal_closed",
        _seal_closed,
        T.with_ctes(
            "SELECT segment_id, CASE WHEN ends + INTERVAL '60 seconds' <= TIMESTAMP '2024-01-20 06:00:30' THEN 'sealed' "
            "ELSE 'hot' END AS place, count(*) AS n FROM (SELECT strftime(ws, '%Y%m%d%H%M') AS segment_id, "
            "ws + INTERVAL '6 hours' AS ends FROM (SELECT time_bucket(INTERVAL '6 hours', coalesce(f_ts, "
            "TIMESTAMP '2024-02-01')) AS ws FROM fields)) GROUP BY ALL",
            *EQ._CTES,
        ),
    ),
    Case(
        "str_window_close",
        _window_close,
        T.with_ctes(
            "SELECT strftime(window_start, '%Y%m%d%H%M') AS id, window_start, window_start + INTERVAL '6 hours' AS window_end, count(*) AS row_count, "
            "count(*) FILTER (late) AS late, count(*) FILTER (future) AS future, min(timestamp) AS time_start, max(timestamp) AS time_end, "
            "coalesce(string_agg(DISTINCT service, ',' ORDER BY service), '') AS sources FROM (SELECT *, CASE WHEN late OR future THEN "
            "time_bucket(INTERVAL '6 hours', arrived) ELSE own END AS window_start FROM (SELECT *, own > arrived AS future, "
            "own + INTERVAL '6 hours 60 seconds' <= arrived AS late FROM (SELECT *, time_bucket(INTERVAL '6 hours', timestamp) AS own FROM arriving))) WHERE window_start + INTERVAL '6 hours 60 seconds' "
            "<= (SELECT max(arrived) FROM arriving) GROUP BY window_start",
            T.LOGS,
            T.ARRIVING,
        ),
    ),
    Case(
        "snk_compaction",
        _compacted,
        T.with_ctes(
            "SELECT strftime(time_bucket(INTERVAL '1 day', coalesce(f_ts, TIMESTAMP '2024-02-01')), '%Y%m%d%H%M') AS segment_id, "
            "count(*) AS n, true AS few_files FROM fields GROUP BY 1",
            *EQ._CTES,
        ),
    ),
    Case("str_late", _late, next(c.sql for c in SQ.CASES if c.name == "seg_placement")),
]
