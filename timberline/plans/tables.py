"""Derived tables the registered queries run on, and their SQL text.

Every table is computed from the given Parquet tables as a whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.attributes import attribute_text
from timberline.functions.timeframe import iso_utc, seconds_interval, segment_start
from timberline.operators.segments import window_stats
from timberline.schema import LogSchema
from timberline.session import checkpointed, require

NOW = dt.datetime(2024, 1, 31)
INGEST_TIME = dt.datetime(2024, 2, 1)
BASE = dt.datetime(2024, 1, 1)
WIDTH = "6h"
WIDTH_SECONDS = 6 * 3600

LOG_SCHEMA = LogSchema()


@dataclass(frozen=True)
class Case:
    """A registered query and, where SQL can say it, the same in DuckDB SQL."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    require(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf.rstrip("/"))


def with_ctes(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


# --- logs: events as log rows ------------------------------------------------


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return as_logs(table(spark, sf, "events"))


def as_logs(events: DataFrame, *more: str) -> DataFrame:
    """Events as log rows; ``more`` names columns to keep."""
    user = F.col("user_id").cast("string")
    bucket = F.col("user_id") % 4
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.when(bucket == 0, "api").when(bucket == 1, "worker").when(bucket == 2, "Web").alias("service"),
        F.when(kind == "error", "error")
        .when(kind == "purchase", "warn")
        .when(kind == "view", "debug")
        .otherwise("info")
        .alias("level"),
        F.concat(kind, F.lit(" by user "), user).alias("message"),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("host"),
        F.lit("events").alias("source"),
        F.col("props").alias("attributes"),
        F.concat(
            F.lit('{"event_type":"'), kind, F.lit('","user_id":'), user, F.lit(',"props":'), F.col("props"), F.lit("}")
        ).alias("raw"),
        *more,
    )


LOGS = """logs AS (SELECT event_id, ts AS timestamp,
  CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' WHEN 2 THEN 'Web' END AS service,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                  WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
  concat(event_type, ' by user ', CAST(user_id AS VARCHAR)) AS message,
  concat('host-', CAST(user_id % 7 AS VARCHAR)) AS host,
  'events' AS source,
  props AS attributes,
  concat('{"event_type":"', event_type, '","user_id":', CAST(user_id AS VARCHAR), ',"props":', props, '}') AS raw
  FROM events)"""


# --- arriving: the logs with the moment each arrived ----------------------------


def arriving(spark, sf):
    """The events with the moment each arrived: most after seconds, some a day late, some ahead of their time."""
    n = F.col("event_id")
    delay = F.when(n % 50 == 7, 90_000).when(n % 60 == 11, -50_000).otherwise(n % 40).cast("bigint")
    arrived = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + delay * 1_000_000).cast("timestamp_ntz")
    return table(spark, sf, "events").withColumn("arrived", arrived)


ARRIVING = """arriving AS (SELECT *, timestamp + to_seconds(CASE WHEN event_id % 50 = 7 THEN 90000
    WHEN event_id % 60 = 11 THEN -50000 ELSE event_id % 40 END) AS arrived FROM logs)"""


# --- mixed: the attribute k as number, text, decimal, null, junk, nested ------


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs(spark, sf)
    k = attribute_text("attributes", "k")
    form = F.col("event_id") % 6
    return rows.withColumn(
        "attributes",
        F.when(form == 0, F.concat(F.lit('{"k":'), k, F.lit("}")))
        .when(form == 1, F.concat(F.lit('{"k":"'), k, F.lit('"}')))
        .when(form == 2, F.concat(F.lit('{"k":'), k, F.lit(".0}")))
        .when(form == 3, F.lit('{"k":null}'))
        .when(form == 4, F.lit('{"k":"n/a","flag":true}'))
        .otherwise(F.concat(F.lit('{"other":{"k":'), k, F.lit(',"tag":"T'), k, F.lit('"}}'))),
    )


MIXED = """mixed AS (SELECT * REPLACE (CASE event_id % 6
    WHEN 0 THEN concat('{"k":', json_extract_string(attributes, '$.k'), '}')
    WHEN 1 THEN concat('{"k":"', json_extract_string(attributes, '$.k'), '"}')
    WHEN 2 THEN concat('{"k":', json_extract_string(attributes, '$.k'), '.0}')
    WHEN 3 THEN '{"k":null}'
    WHEN 4 THEN '{"k":"n/a","flag":true}'
    ELSE concat('{"other":{"k":', json_extract_string(attributes, '$.k'), ',"tag":"T',
                json_extract_string(attributes, '$.k'), '"}}') END AS attributes) FROM logs)"""


def big(spark: SparkSession, sf: str) -> DataFrame:
    """The logs with an integer attribute n, near where doubles stop telling integers apart."""
    forms = (2**53, 2**53 + 1, 10**27, f'"{10**27 + 1}"', f'"+0{10**27 + 1}.00"', "-7.0", -8)
    value = F.element_at(F.array(*[F.lit(str(f)) for f in forms]), (F.col("event_id") % 7 + 1).cast("int"))
    return logs(spark, sf).withColumn("attributes", F.concat(F.lit('{"n":'), value, F.lit("}")))


# --- segs: one catalog row per six-hour window of logs ------------------------


def _ordinal(start: Column) -> Column:
    base = F.unix_timestamp(F.lit(BASE.isoformat(sep=" ")).cast("timestamp"))
    return ((F.unix_timestamp(start.cast("timestamp")) - base) / WIDTH_SECONDS).cast("bigint")


def segs(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog, as a snapshot: one pass over the events, then a row per window."""
    return checkpointed(seg_rows(spark, sf))


def seg_rows(spark: SparkSession, sf: str) -> DataFrame:
    stats = window_stats(logs(spark, sf), WIDTH, LogSchema(source="service"), sized="raw")
    n = F.col("n")
    lost = n % 17 == 3
    state = F.when(lost, "lost").when(n % 5 < 2, "sealed").when(n % 5 < 4, "archived").otherwise("rehydrated")
    return (
        stats.withColumn("window_start", segment_start(F.col("id")))
        .withColumn("n", _ordinal(F.col("window_start")))
        .select(
            "id",
            "n",
            "window_start",
            state.alias("state"),
            "time_start",
            "time_end",
            "row_count",
            "size_bytes",
            F.when(n % 2 == 1, (F.col("size_bytes") / 10).cast("bigint")).alias("size_compressed"),
            F.when((n % 5 != 3) & ~lost, F.concat(F.lit("/data/segment-"), F.col("id"), F.lit(".parquet"))).alias("local_path"),
            F.when((state == "archived") | ((n % 20 == 9) & ~lost), F.concat(F.lit("ref-"), F.col("id"))).alias("archive_ref"),
            F.sha2(F.col("id"), 256).alias("parquet_sha256"),
            (F.col("window_start") + seconds_interval(WIDTH_SECONDS + 60)).alias("sealed_at"),
            F.when((state == "rehydrated") & (n % 10 != 4), F.col("time_end") + seconds_interval(7 * 86400)).alias(
                "evict_after"
            ),
            "sources",
        )
    )


SEGS = """seg_base AS (SELECT time_bucket(INTERVAL '6 hours', timestamp) AS window_start, count(*) AS row_count,
    min(timestamp) AS time_start, max(timestamp) AS time_end, CAST(sum(length(raw)) AS BIGINT) AS size_bytes,
    list_sort(list(DISTINCT service) FILTER (WHERE service IS NOT NULL)) AS sources FROM logs GROUP BY 1),
  seg_num AS (SELECT *, strftime(window_start, '%Y%m%d%H%M') AS id,
    CAST(epoch(window_start) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) // 21600 AS n FROM seg_base),
  seg_state AS (SELECT *, CASE WHEN n % 17 = 3 THEN 'lost' WHEN n % 5 < 2 THEN 'sealed' WHEN n % 5 < 4 THEN 'archived' ELSE 'rehydrated' END AS state
    FROM seg_num),
  segs AS (SELECT id, n, window_start, state, time_start, time_end, row_count, size_bytes,
    CASE WHEN n % 2 = 1 THEN size_bytes // 10 END AS size_compressed,
    CASE WHEN n % 5 <> 3 AND n % 17 <> 3 THEN concat('/data/segment-', id, '.parquet') END AS local_path,
    CASE WHEN state = 'archived' OR (n % 20 = 9 AND n % 17 <> 3) THEN concat('ref-', id) END AS archive_ref,
    sha256(id) AS parquet_sha256,
    window_start + INTERVAL '6 hours' + INTERVAL '60 seconds' AS sealed_at,
    CASE WHEN state = 'rehydrated' AND n % 10 <> 4 THEN time_end + INTERVAL '7 days' END AS evict_after,
    sources FROM seg_state)"""


# --- ndjson: one raw line per event, ten forms --------------------------------


def ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, value``: raw lines as they arrive, bad ones included."""
    ts = F.col("ts")
    iso = iso_utc(ts)
    micros = F.unix_micros(ts.cast("timestamp"))
    seconds = (micros / 1_000_000).cast("bigint").cast("string")
    millis = F.floor(micros / 1_000).cast("bigint").cast("string")
    user = F.col("user_id").cast("string")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    forms = [
        text(
            '{"timestamp":"', iso, '","level":"INFO","service":"api","host":"web-1","message":"m","user":{"id":',
            user, ',"name":"n"},"k":1}',
        ),
        text('{"ts":', seconds, ',"severity":"Warning","app":"worker","msg":42}'),
        text('{"time":', millis, ',"level":5,"hostname":"h1","message":true}'),
        F.lit('{"@timestamp":"not-a-date","level":"weird","message":{"a":1}}'),
        F.lit("not json"),
        F.lit("[1,2]"),
        F.lit(""),
        F.lit(
            '{"timestamp":null,"ts":"2024-01-01T02:00:00+02:00","level":[1],"severity":"crit",'
            '"service":"","app":"fallback"}'
        ),
        text('{"timestamp":"', iso, '","level":"info","message":"x"}\r'),
        F.lit('{"message":"no level no ts","service":7}'),
    ]
    value = forms[-1]
    for i, form in enumerate(forms[:-1]):
        value = F.when(F.col("event_id") % 10 == i, form).otherwise(value)
    return table(spark, sf, "events").select("event_id", value.alias("value"))


NDJSON = r"""ndjson AS (SELECT event_id, CASE event_id % 10
    WHEN 0 THEN concat('{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'),
      '","level":"INFO","service":"api","host":"web-1","message":"m","user":{"id":', user_id, ',"name":"n"},"k":1}')
    WHEN 1 THEN concat('{"ts":', epoch_us(ts) // 1000000, ',"severity":"Warning","app":"worker","msg":42}')
    WHEN 2 THEN concat('{"time":', epoch_us(ts) // 1000, ',"level":5,"hostname":"h1","message":true}')
    WHEN 3 THEN '{"@timestamp":"not-a-date","level":"weird","message":{"a":1}}'
    WHEN 4 THEN 'not json'
    WHEN 5 THEN '[1,2]'
    WHEN 6 THEN ''
    WHEN 7 THEN '{"timestamp":null,"ts":"2024-01-01T02:00:00+02:00","level":[1],"severity":"crit","service":"","app":"fallback"}'
    WHEN 8 THEN concat('{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '","level":"info","message":"x"}', chr(13))
    ELSE '{"message":"no level no ts","service":7}' END AS value FROM events)"""

LINES = r"""lines AS (SELECT event_id, regexp_replace(value, '\r$', '') AS line FROM ndjson
    WHERE length(regexp_replace(value, '\r$', '')) > 0)"""

DOCS = """docs AS (SELECT event_id, line, CAST(line AS JSON) AS j FROM
    (SELECT event_id, CASE WHEN json_valid(line) AND line LIKE '{%' THEN line END AS line FROM lines) WHERE line IS NOT NULL)"""


# --- other tables as logs -----------------------------------------------------

DOC_SCHEMA = LogSchema(
    timestamp=None, message="text", raw=None, attributes=None, source="source", id="doc_id",
    dims=("lang", "source"), folded=frozenset(),
)
CHAT_SCHEMA = LogSchema(
    timestamp=None, message="text", raw=None, attributes=None, source="role", id="turn",
    dims=("role",), folded=frozenset(),
)
ORDER_SCHEMA = LogSchema(
    timestamp="o_orderdate", message="o_orderpriority", raw=None, attributes=None, source="o_orderstatus",
    id="o_orderkey", dims=("o_orderstatus", "o_orderpriority"), folded=frozenset(),
)
SHIP_SCHEMA = LogSchema(
    timestamp="l_shipdate", message="l_returnflag", raw=None, attributes=None, source="l_linestatus", id=None,
    dims=("l_returnflag", "l_linestatus"), folded=frozenset(),
)
