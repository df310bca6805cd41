"""Queries over a sealed store through its catalog.

The store holds every event in the segment it was placed in when it arrived, so some segments hold
rows from far outside their window. The catalog has the bounds of the rows; some segments are lost, others archived without
a local copy, though the files of all of them still lie in the store.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.functions.timeframe import segment_start
from timberline.operators import facets as FC
from timberline.operators import search as S
from timberline.operators.request import SearchRequest, run
from timberline.operators.segments import placement_at, segment_stats
from timberline.plans import tables as T
from timberline.plans.facet_queries import _ALL, _value_sql
from timberline.plans.tables import Case
from timberline.session import checkpointed, scratch_path
from timberline.sources import store
from timberline.sources.scan import catalog_scan

_RANGE = ("2024-01-09T03:00:00Z", "2024-01-15T21:00:00Z")
_WHERE = P.all_of(P.leaf("level", "in", ["error", "warn"]), P.leaf("attributes.k", "gte", 20))
_SORT = [("service", "asc"), ("timestamp", "desc")]
_LIMIT = 40
_SAMPLE = 8


def placed_store(spark, sf):
    """The store and its catalog."""
    rows = T.as_logs(T.arriving(spark, sf), "arrived")
    segment = placement_at(F.col("timestamp"), F.col("arrived"), T.WIDTH)["segment_id"]
    path = scratch_path(spark, "placed")
    store.seal(rows, path, T.WIDTH, segment=segment)
    stored = store.read_store(spark, path)
    n = ((F.unix_timestamp(segment_start(F.col("id"), False)) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / T.WIDTH_SECONDS).cast("bigint")
    lost, far = F.pmod(n, F.lit(7)) == 3, F.pmod(n, F.lit(5)) == 1
    catalog = segment_stats(stored, "segment_id").select(
        "id", F.when(lost, "lost").when(far, "archived").otherwise("sealed").alias("state"), "time_start", "time_end", "row_count",
        F.when(~lost & ~far, F.concat(F.lit("segment-"), "id")).alias("local_path"),
    )
    return stored, checkpointed(catalog)


def _search(spark, sf):
    stored, catalog = placed_store(spark, sf)
    rows = catalog_scan(stored, catalog, *_RANGE)
    return S.matching(rows, start=_RANGE[0], end=_RANGE[1], where=P.leaf("level", "eq", "error")).select("event_id", "timestamp", "segment_id")


def request():
    return SearchRequest(*_RANGE, where=_WHERE, sort=_SORT, limit=_LIMIT, facets=_ALL)


def _request(spark, sf):
    """All parts of one answer as rows (part, name, value, n)."""
    stored, catalog = placed_store(spark, sf)
    answer = run(stored, request(), catalog=catalog, sample=_SAMPLE)
    none = F.lit("")
    page = answer.page.select(F.lit("page").alias("part"), F.col("has_more").cast("string").alias("name"), F.col("event_id").cast("string").alias("value"), F.lit(1).cast("bigint").alias("n"))
    count = answer.count.select(F.lit("count"), none, none, "count")
    facets = answer.facets.select(F.concat(F.lit("facet of "), F.col("sample_segments").cast("string")), "facet", "value", "count")
    stats = answer.stats.select(F.expr("stack(3, 'rows_returned', rows_returned, 'rows_scanned', rows_scanned, 'segments_read', segments_read) AS (name, n)"))
    return page.union(count).union(facets).union(stats.select(F.lit("stats"), "name", none, "n"))


def _stats(spark, sf):
    stored, catalog = placed_store(spark, sf)
    ask = SearchRequest(*_RANGE, where=P.all_of(P.leaf("service", "eq", "web"), P.leaf("attributes.k", "eq", 17)), limit=300)
    return run(stored, ask, catalog=catalog).stats


_PLACED = f"""placed AS (SELECT *, strftime(CASE WHEN own > arrived OR own + INTERVAL '6 hours 60 seconds' <= arrived
    THEN time_bucket(INTERVAL '6 hours', arrived) ELSE own END, '%Y%m%d%H%M') AS segment_id
    FROM (SELECT *, time_bucket(INTERVAL '6 hours', timestamp) AS own FROM arriving)),
  numbered AS (SELECT segment_id AS id, min(timestamp) AS time_start, max(timestamp) AS time_end,
    CAST(epoch(strptime(segment_id, '%Y%m%d%H%M')) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) // 21600 AS n FROM placed GROUP BY 1),
  chosen AS (SELECT id, row_number() OVER (ORDER BY time_start DESC, id DESC) <= {_SAMPLE} AS sampled FROM numbered
    WHERE ((n % 7) + 7) % 7 <> 3 AND ((n % 5) + 5) % 5 <> 1 AND time_start <= TIMESTAMP '2024-01-15 21:00:00' AND time_end >= TIMESTAMP '2024-01-09 03:00:00'),
  scanned AS (SELECT p.*, sampled, timestamp BETWEEN TIMESTAMP '2024-01-09 03:00:00' AND TIMESTAMP '2024-01-15 21:00:00' AS inside,
    CAST(json_extract_string(attributes, '$.k') AS DOUBLE) AS k FROM placed p JOIN chosen ON id = segment_id)"""

_FACETS = " UNION ALL ".join(
    f"SELECT '{f.name}' AS facet, {f.cap} AS cap, {_value_sql(f.field)} AS value, segment_id FROM matched WHERE sampled" for f in _ALL
)

CASES = [
    Case(
        "qry_catalog",
        _search,
        T.with_ctes("SELECT event_id, timestamp, segment_id FROM scanned WHERE inside AND level = 'error'", T.LOGS, T.ARRIVING, _PLACED),
    ),
    Case(
        "qry_request",
        _request,
        T.with_ctes(
            "SELECT 'page' AS part, CAST((SELECT count(*) FROM matched) > 40 AS VARCHAR) AS name, CAST(event_id AS VARCHAR) AS value, 1 AS n "
            "FROM (SELECT event_id FROM matched ORDER BY service NULLS FIRST, timestamp DESC, event_id DESC LIMIT 40) "
            "UNION ALL SELECT 'count', '', '', count(*) FROM matched "
            "UNION ALL SELECT concat('facet of ', segments), facet, value, n FROM ranked JOIN held USING (facet) WHERE rank <= cap "
            "UNION ALL SELECT 'stats', 'rows_returned', '', least(count(*), 40) FROM matched UNION ALL SELECT 'stats', 'rows_scanned', '', count(*) FROM scanned "
            "UNION ALL SELECT 'stats', 'segments_read', '', count(DISTINCT segment_id) FROM scanned",
            T.LOGS,
            T.ARRIVING,
            _PLACED,
            "matched AS (SELECT * FROM scanned WHERE inside AND level IN ('error', 'warn') AND k >= 20)",
            f"pairs AS (SELECT * FROM ({_FACETS}) WHERE value IS NOT NULL)",
            "held AS (SELECT facet, count(DISTINCT segment_id) AS segments FROM pairs GROUP BY facet)",
            "ranked AS (SELECT facet, cap, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS rank FROM pairs GROUP BY facet, cap, value)",
        ),
    ),
    Case(
        "qry_stats",
        _stats,
        T.with_ctes(
            "SELECT least(count(*) FILTER (inside AND lower(service) = 'web' AND k = 17), 300) AS rows_returned, count(*) AS rows_scanned, "
            "count(DISTINCT segment_id) AS segments_read FROM scanned",
            T.LOGS,
            T.ARRIVING,
            _PLACED,
        ),
    ),
]
