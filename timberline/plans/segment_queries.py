"""Segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.timeframe import iso_utc, segment_id, segment_start, time_literal, window_start
from timberline.operators import segments as SG
from timberline.plans import tables as T
from timberline.plans.tables import Case
from timberline.schema import LogSchema
from timberline.sources import store

_SID = "strftime(time_bucket(INTERVAL '{w}', timestamp), '%Y%m%d%H%M')"


def _window(spark, sf):
    ts = F.col("timestamp")
    return T.logs(spark, sf).select(
        "event_id",
        window_start(ts, "5m").alias("w5m"),
        window_start(ts, "1h").alias("w1h"),
        window_start(ts, "6h").alias("w6h"),
        window_start(ts, "24h").alias("w24h"),
    )


def _id(spark, sf):
    rows = T.logs(spark, sf).withColumn("segment_id", segment_id(window_start(F.col("timestamp"), "30m")))
    return rows.select("event_id", "segment_id", segment_start(F.col("segment_id")).alias("window_start"))


def _placement(spark, sf):
    placed = SG.place_events(T.logs(spark, sf), "2024-01-20T06:00:30Z", T.WIDTH)
    return placed.select("event_id", "segment_id", "placement", "intended_segment")


def _stats(spark, sf):
    stats = SG.window_stats(T.logs(spark, sf), "1h", LogSchema(source="service"))
    return stats.withColumn("sources", F.array_join("sources", ","))


def _empty(spark, sf):
    stats = SG.window_stats(T.logs(spark, sf), "5m")
    return SG.empty_windows(stats, "2023-12-31T12:30:00Z", "2024-02-01T00:00:00Z", "5m")


def _reconcile_inputs(spark, sf):
    n = F.col("n")
    rows = T.segs(spark, sf)
    active = rows.filter(n % 4 == 1).select("id")
    sealed = rows.filter((n % 3 != 0) & F.col("local_path").isNotNull()).select("id")
    catalog = rows.filter(n % 6 != 5).select("id", F.when(n % 8 == 1, "active").otherwise(F.col("state")).alias("state"))
    return active, sealed, catalog


def _reconcile(spark, sf):
    return SG.reconcile(*_reconcile_inputs(spark, sf))


def _overlap(spark, sf):
    return SG.overlapping(
        T.segs(spark, sf), time_literal("2024-01-09T05:00:00Z"), time_literal("2024-01-12T13:00:00Z")
    ).select("id", "state", "time_start", "time_end")


def _eight_hours(spark, sf):
    return SG.window_stats(T.logs(spark, sf), "8h").select("id", "time_start", "time_end")


def _overlap_join(spark, sf):
    existing = T.segs(spark, sf).select("id", "time_start", "time_end")
    return SG.overlap_join(_eight_hours(spark, sf), existing).select(
        F.col("id").alias("import_id"), F.col("right_id").alias("segment_id"), "right_time_start", "right_time_end"
    )


def _levels(spark, sf):
    """The catalog, each segment's end moved by a second, an hour, ... up to centuries."""
    seconds = F.pow(F.lit(60.0), F.col("n") % 6).cast("bigint")
    end = F.col("time_end").cast("timestamp") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return T.segs(spark, sf).select("id", "time_start", end.cast("timestamp_ntz").alias("time_end"))


def _overlap_levels(spark, sf):
    pairs = SG.overlap_join(_levels(spark, sf), _eight_hours(spark, sf))
    return pairs.select("id", F.col("right_id").alias("import_id"))


def _list(spark, sf):
    page, _ = SG.list_segments(
        T.segs(spark, sf),
        states=["sealed", "rehydrated"],
        start="2024-01-04T00:00:00Z",
        end="2024-01-28T00:00:00Z",
        source="Web",
        limit=30,
        offset=5,
    )
    return page.select("id", "state", "time_start", "row_count")


def _list_total(spark, sf):
    return SG.list_segments(T.segs(spark, sf), states=["archived"])[1]


def _sealable(spark, sf):
    rows = T.segs(spark, sf).select(
        "id", "row_count", F.when(F.col("n") % 3 == 0, "active").otherwise("sealed").alias("state")
    )
    return SG.sealable(rows, "2024-01-20T06:00:30Z", T.WIDTH).select("id", "row_count")


def _by_state(spark, sf):
    return SG.totals_by_state(T.segs(spark, sf))


def _archive_key(spark, sf):
    start = F.col("time_start")
    return T.segs(spark, sf).select(
        "id",
        store.archive_key(F.col("id"), start, "parquet", "/logs/prod/").alias("data_key"),
        store.archive_key(F.col("id"), start, "manifest").alias("manifest_key"),
    )


def _copy_plan(spark, sf):
    rows, n = T.segs(spark, sf), F.col("n")
    sha = F.when(n % 13 == 2, F.sha2("parquet_sha256", 256)).otherwise(F.col("parquet_sha256"))
    remote = rows.filter(n % 11 != 5).select(F.col("id").alias("segment_id"), sha.alias("sha"))
    local = rows.filter(F.col("local_path").isNotNull())
    return store.copy_plan(local, remote, "cold").select("id", "data_action", "data_key", "manifest_key")


def _manifest_docs(spark, sf):
    """Manifest documents of segs; some lack a field or carry a wrong version."""
    n = F.col("n")
    doc = F.to_json(
        F.struct(
            F.when(n % 9 != 4, F.lit(1)).otherwise(F.lit(2)).alias("manifest_version"),
            F.when(n % 7 != 2, F.col("id")).alias("segment_id"),
            F.when(n % 5 != 1, iso_utc(F.col("time_start"))).alias("time_start"),
            iso_utc(F.col("time_end")).alias("time_end"),
            "row_count",
            F.when(n % 11 != 3, F.col("parquet_sha256")).otherwise(F.lit("")).alias("parquet_sha256"),
            F.when(n % 13 != 6, F.concat(F.lit("segment-"), F.col("id"), F.lit(".parquet"))).alias("parquet_filename"),
            F.col("sources").alias("source_names"),
        )
    )
    return T.segs(spark, sf).select("id", doc.alias("document"))


def _manifest_valid(spark, sf):
    valid, rejected = store.check_manifests(_manifest_docs(spark, sf))
    good = valid.select("id", F.col("segment_id"), "row_count", F.lit(None).cast("string").alias("error"))
    bad = rejected.select(
        "id", F.lit(None).cast("string").alias("segment_id"), F.lit(None).cast("bigint").alias("row_count"), "error"
    )
    return good.unionByName(bad)


_MANIFEST_SQL = """SELECT id, CASE WHEN error IS NULL THEN id END AS segment_id,
  CASE WHEN error IS NULL THEN row_count END AS row_count, error FROM (SELECT *, CASE
    WHEN n % 9 = 4 THEN 'unsupported manifest_version 2' WHEN n % 7 = 2 THEN 'missing segment_id'
    WHEN n % 11 = 3 THEN 'missing parquet_sha256' WHEN n % 13 = 6 THEN 'missing parquet_filename'
    WHEN n % 5 = 1 THEN 'missing time bounds' END AS error FROM segs)"""


CASES = [
    Case(
        "seg_window",
        _window,
        T.with_ctes(
            "SELECT event_id, time_bucket(INTERVAL '5 minutes', timestamp) AS w5m, time_bucket(INTERVAL '1 hour', timestamp) "
            "AS w1h, time_bucket(INTERVAL '6 hours', timestamp) AS w6h, time_bucket(INTERVAL '24 hours', timestamp) AS w24h "
            "FROM logs",
            T.LOGS,
        ),
    ),
    Case(
        "seg_id",
        _id,
        T.with_ctes(
            f"SELECT event_id, {_SID.format(w='30 minutes')} AS segment_id, "
            "time_bucket(INTERVAL '30 minutes', timestamp) AS window_start FROM logs",
            T.LOGS,
        ),
    ),
    Case(
        "seg_placement",
        _placement,
        T.with_ctes(
            "SELECT event_id, CASE WHEN ws IN (TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-20 06:00:00') THEN id "
            "ELSE '202401200600' END AS segment_id, CASE WHEN ws > TIMESTAMP '2024-01-20 06:00:30' THEN 'future' "
            "WHEN ws < TIMESTAMP '2024-01-20 00:00:00' THEN 'late' ELSE 'on_time' END AS placement, CASE WHEN ws NOT IN "
            "(TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-20 06:00:00') THEN id END AS intended_segment FROM "
            f"(SELECT event_id, time_bucket(INTERVAL '6 hours', timestamp) AS ws, {_SID.format(w='6 hours')} AS id FROM logs)",
            T.LOGS,
        ),
    ),
    Case(
        "seg_stats",
        _stats,
        T.with_ctes(
            f"SELECT {_SID.format(w='1 hour')} AS id, count(*) AS row_count, min(timestamp) AS time_start, max(timestamp) AS "
            "time_end, coalesce(string_agg(DISTINCT service, ',' ORDER BY service), '') AS sources FROM logs GROUP BY 1",
            T.LOGS,
        ),
    ),
    Case(
        "seg_empty",
        _empty,
        T.with_ctes(
            "SELECT strftime(ws, '%Y%m%d%H%M') AS id, ws AS window_start FROM (SELECT unnest(generate_series("
            "TIMESTAMP '2023-12-31 12:30:00', TIMESTAMP '2024-01-31 23:55:00', INTERVAL '5 minutes')) AS ws) WHERE ws NOT IN "
            "(SELECT time_bucket(INTERVAL '5 minutes', timestamp) FROM logs)",
            T.LOGS,
        ),
    ),
    Case(
        "seg_reconcile",
        _reconcile,
        T.with_ctes(
            "SELECT id, has_active, has_sealed, state, CASE WHEN state IS NULL AND has_sealed THEN 'register_sealed' "
            "WHEN state IS NULL AND has_active THEN 'register_active' WHEN state = 'active' AND (has_sealed OR NOT has_active) "
            "THEN 'mark_lost' WHEN state = 'sealed' AND NOT has_sealed THEN 'mark_lost' ELSE 'keep' END AS action, "
            "has_active AND has_sealed AS orphan_active FROM (SELECT id, n % 4 = 1 AS has_active, "
            "n % 3 <> 0 AND local_path IS NOT NULL AS has_sealed, CASE WHEN n % 6 = 5 THEN NULL WHEN n % 8 = 1 THEN 'active' "
            "ELSE state END AS state FROM segs) WHERE has_active OR has_sealed OR state IS NOT NULL",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case(
        "seg_overlap",
        _overlap,
        T.with_ctes(
            "SELECT id, state, time_start, time_end FROM segs WHERE state <> 'lost' AND "
            "time_start <= TIMESTAMP '2024-01-12 13:00:00' AND time_end >= TIMESTAMP '2024-01-09 05:00:00'",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case(
        "seg_overlap_join",
        _overlap_join,
        T.with_ctes(
            "SELECT i.id AS import_id, s.id AS segment_id, s.time_start AS right_time_start, s.time_end AS right_time_end "
            "FROM imports i JOIN segs s ON i.time_start <= s.time_end AND s.time_start <= i.time_end",
            T.LOGS,
            T.SEGS,
            f"imports AS (SELECT {_SID.format(w='8 hours')} AS id, min(timestamp) AS time_start, max(timestamp) AS time_end "
            "FROM logs GROUP BY 1)",
        ),
    ),
    Case(
        "seg_overlap_levels",
        _overlap_levels,
        T.with_ctes(
            "SELECT s.id, i.id AS import_id FROM (SELECT id, time_start, time_end + to_seconds(CAST(pow(60, n % 6) AS BIGINT)) "
            "AS time_end FROM segs) s JOIN imports i ON i.time_start <= s.time_end AND s.time_start <= i.time_end",
            T.LOGS,
            T.SEGS,
            f"imports AS (SELECT {_SID.format(w='8 hours')} AS id, min(timestamp) AS time_start, max(timestamp) AS time_end "
            "FROM logs GROUP BY 1)",
        ),
    ),
    Case(
        "seg_list",
        _list,
        T.with_ctes(
            "SELECT id, state, time_start, row_count FROM segs WHERE state IN ('sealed', 'rehydrated') AND "
            "time_end >= TIMESTAMP '2024-01-04' AND time_start <= TIMESTAMP '2024-01-28' AND list_contains(sources, 'Web') "
            "ORDER BY time_start DESC, id DESC LIMIT 30 OFFSET 5",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case(
        "seg_list_total",
        _list_total,
        T.with_ctes("SELECT count(*) AS total FROM segs WHERE state = 'archived'", T.LOGS, T.SEGS),
    ),
    Case(
        "seg_sealable",
        _sealable,
        T.with_ctes(
            "SELECT id, row_count FROM segs WHERE n % 3 = 0 AND "
            "window_start + INTERVAL '6 hours' <= TIMESTAMP '2024-01-20 05:59:30'",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case(
        "seg_by_state",
        _by_state,
        T.with_ctes(
            "SELECT state, count(*) AS segments, CAST(sum(CASE WHEN size_compressed > 0 THEN size_compressed ELSE size_bytes "
            "END) AS BIGINT) AS bytes FROM segs GROUP BY 1",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case(
        "snk_archive_key",
        _archive_key,
        T.with_ctes(
            "SELECT id, concat('logs/prod/segments/', strftime(time_start, '%Y/%m/%d/%H'), '/segment-', id, '.parquet') AS "
            "data_key, concat('segments/', strftime(time_start, '%Y/%m/%d/%H'), '/segment-', id, '.manifest.json') AS "
            "manifest_key FROM segs",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case(
        "snk_archive_plan",
        _copy_plan,
        T.with_ctes(
            "SELECT id, CASE WHEN n % 11 = 5 THEN 'upload' WHEN n % 13 = 2 THEN 'overwrite' ELSE 'skip' END AS data_action, "
            "concat('cold/segments/', strftime(time_start, '%Y/%m/%d/%H'), '/segment-', id, '.parquet') AS data_key, "
            "concat('cold/segments/', strftime(time_start, '%Y/%m/%d/%H'), '/segment-', id, '.manifest.json') AS manifest_key "
            "FROM segs WHERE local_path IS NOT NULL",
            T.LOGS,
            T.SEGS,
        ),
    ),
    Case("src_manifest_valid", _manifest_valid, T.with_ctes(_MANIFEST_SQL, T.LOGS, T.SEGS)),
]
