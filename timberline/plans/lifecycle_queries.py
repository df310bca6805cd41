"""Catalog jobs: retention, archive, restore, import, audit."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from timberline.operators import lifecycle as L
from timberline.operators.segments import window_stats, with_segment
from timberline.plans import storage_queries as SQ
from timberline.plans import tables as T
from timberline.plans.tables import Case
from timberline.session import checkpointed, scratch_path
from timberline.sources import store

_AGE = dt.timedelta(days=20)
_POLICY = L.RetentionPolicy(max_age=_AGE, max_bytes=150_000, archive_before_delete=True, archive_available=True)
_TTL = dt.timedelta(days=3)


def _sql(body: str, *ctes: str) -> str:
    return T.with_ctes(body, T.LOGS, T.SEGS, *ctes)


_LOCAL = "local AS (SELECT * FROM segs WHERE local_path IS NOT NULL AND state IN ('sealed', 'archived', 'rehydrated'))"
_KEEP = "(state = 'sealed' AND sealed_at > TIMESTAMP '2024-01-30 23:00:00')"
_OLD = "time_end < TIMESTAMP '2024-01-11 00:00:00'"
# Unprotected segments, the bytes freed before each, and the overshoot.
_FREED = f"""freed AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY time_end, id ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS before FROM local WHERE NOT {_KEEP}),
  over_size AS (SELECT *, before < (SELECT sum(size_bytes) - 150000 FROM local) AS large FROM freed)"""
_PLAN = f"""plan AS (SELECT id, state, time_end, size_bytes, archive_ref,
    CASE WHEN {_OLD} THEN 'age' ELSE 'size' END AS reason,
    CASE WHEN state = 'sealed' AND archive_ref IS NULL THEN 'archive_then_delete' ELSE 'delete' END AS action,
    CASE WHEN state = 'sealed' AND archive_ref IS NULL THEN 'sealed' WHEN state = 'archived' THEN 'archived'
      WHEN state = 'rehydrated' AND archive_ref IS NOT NULL THEN 'archived' ELSE 'lost' END AS next_state
    FROM over_size WHERE {_OLD} OR large)"""


def _age(spark, sf):
    local = L.local_segments(T.segs(spark, sf))
    return local.filter(L.is_too_old(T.NOW, _AGE) & ~L.is_protected(T.NOW)).select("id", "state", "time_end")


def _size(spark, sf):
    return L.over_size(T.segs(spark, sf), 150_000, T.NOW)


def _protected(spark, sf):
    """An hour in which one sealed segment was just written and others long before or later."""
    return T.segs(spark, sf).select("id", "state", "sealed_at", L.is_protected("2024-01-30T06:30:00Z").alias("protected"))


def _candidates(spark, sf):
    return L.local_segments(T.segs(spark, sf)).select("id", "state", "time_end", "size_bytes")


def _decide(spark, sf):
    rows = T.segs(spark, sf)
    return rows.withColumns(L.decide(rows, _POLICY)).select("id", "state", "action", "next_state")


def _plan(spark, sf):
    return L.retention_plan(T.segs(spark, sf), _POLICY, T.NOW)


def _plan_summary(spark, sf):
    rows = T.segs(spark, sf)
    return L.plan_summary(rows, L.retention_plan(rows, _POLICY, T.NOW))


def _apply(spark, sf):
    rows = T.segs(spark, sf)
    plan = L.retention_plan(rows, _POLICY, T.NOW)
    copies = rows.filter(F.col("state") == "sealed").select(
        "id", (F.col("row_count") % 2 == 0).alias("ok"), F.concat(F.lit("copy-"), F.col("id")).alias("archive_ref")
    )
    return L.apply_retention(rows, plan, copies, T.NOW).select("id", "state", "local_path", "archive_ref", "evict_after")


def _changes(spark, sf):
    """Catalog changes: one per level and window, the largest event id is the version."""
    events = with_segment(T.logs(spark, sf), T.WIDTH)
    per_level = events.groupBy(F.col("segment_id").alias("id"), "level").agg(F.max("event_id").alias("version"))
    error, warn = F.col("level") == "error", F.col("level") == "warn"
    return per_level.select(
        "id",
        "version",
        F.when(error, "lost").when(warn, "archived").alias("state"),
        F.when(warn, F.concat(F.lit("ref2-"), F.col("id"))).alias("archive_ref"),
        F.when(error, F.array(F.lit("local_path"), F.lit("evict_after")))
        .otherwise(F.array().cast("array<string>"))
        .alias("cleared"),
    )


def _state(spark, sf):
    rows = T.segs(spark, sf)
    return L.apply_changes(rows, _changes(spark, sf)).select(
        "id", "state", "local_path", "archive_ref", "evict_after", "row_count"
    )


def _archive_select(spark, sf):
    return L.archive_candidates(T.segs(spark, sf), T.NOW, dt.timedelta(days=10)).select("id", "time_end", "local_path")


def _restore(spark, sf):
    return L.restore_candidates(T.segs(spark, sf), "2024-01-06T00:00:00Z", "2024-01-19T09:00:00Z")


def _restore_ids(spark, sf):
    ids = [f"202401{day:02d}{hour:02d}00" for day in range(2, 20) for hour in (0, 12)] + ["never"]
    return L.restore_candidates(T.segs(spark, sf), segments=ids).select("id", "state", "already_local")


def _restore_manifest(spark, sf):
    """A catalog whose figures are stale, restored from the manifests of a real store."""
    manifests = SQ.sealed_manifests(spark, sf)
    stale = _restore(spark, sf).withColumns({"row_count": F.lit(-1).cast("bigint"), "parquet_sha256": F.lit("stale")})
    rows = L.apply_restore(stale, T.NOW, _TTL, False, "/data/rehydrated", manifests)
    known = manifests.select(F.col("segment_id").alias("id"), F.col("parquet_sha256").alias("_sha"), F.col("size_compressed").alias("_size"))
    return rows.join(known, "id").select(
        "id",
        "row_count",
        F.array_join("sources", ",").alias("sources"),
        (F.col("parquet_sha256") == F.col("_sha")).alias("own_checksum"),
        (F.col("size_compressed") == F.col("_size")).alias("own_size"),
    )


def _restore_select(spark, sf):
    return _restore(spark, sf).select("id", "state", "already_local", "size_bytes")


def _restore_estimate(spark, sf):
    scaled = _restore(spark, sf).withColumn("size_bytes", F.col("size_bytes") * 10_000)
    return L.restore_estimate(scaled)


def _restore_apply(spark, sf):
    return L.apply_restore(_restore(spark, sf), T.NOW, _TTL, False, "/data/rehydrated").select(
        "id", "state", "local_path", "evict_after"
    )


def _evict(spark, sf):
    return L.expired(T.segs(spark, sf), "2024-01-25T00:00:00Z").select("id", "evict_after", "next_state")


def _evict_apply(spark, sf):
    return L.apply_eviction(T.segs(spark, sf), "2024-01-25T00:00:00Z").select(
        "id", "state", "local_path", "evict_after"
    )


def _break_files(batches):
    """Remove or spoil files, as ``fate`` says; a task that runs again does no harm."""
    from pyarrow import fs

    for batch in batches:
        for key, fate in zip(batch["key"], batch["fate"]):
            system, name = store.open_uri(key)
            if fate == "spoil":
                with system.open_output_stream(name) as out:
                    out.write(b"PAR1 spoilt PAR1")
            elif system.get_file_info(name).type != fs.FileType.NotFound:
                system.delete_file(name)
        yield batch[["key"]]


def _broken_archive(spark, sf):
    """A real archive of all segments of the log table, some data or manifests removed and some data spoilt."""
    path = SQ.archived(spark, sf)
    number = T.segs(spark, sf).select(F.col("id").alias("segment_id"), "n")
    objects = store.list_archive(spark, path).join(number, "segment_id")
    n, data = F.col("n"), F.col("kind") == "parquet"
    fate = F.when(data & (n % 7 == 3), "remove").when(~data & (n % 11 == 5), "remove").when(data & (n % 13 == 2), "spoil")
    broken = objects.select("key", fate.alias("fate")).where("fate is not null")
    checkpointed(broken.repartition("key").mapInPandas(_break_files, "key string"))
    return path


def _audit(spark, sf):
    objects = store.archive_objects(spark, _broken_archive(spark, sf))
    return L.audit_archive(objects, T.segs(spark, sf)).select("segment_id", "finding")


def _audit_ids(spark, sf):
    path = _broken_archive(spark, sf)
    wanted = T.segs(spark, sf).filter(F.col("time_start") < F.lit("2024-01-15").cast("timestamp_ntz"))
    found = L.audit_archive(store.archive_objects(spark, path), ids=wanted)
    name = {c: F.regexp_extract(c, "(segments/.*)$", 1) for c in ("data_key", "manifest_key")}
    return found.withColumns(name).select("segment_id", "finding", "data_key", "manifest_key")


def _checksum(spark, sf):
    path = _broken_archive(spark, sf)
    data = store.list_archive(spark, path).filter(F.col("kind") == "parquet").select(F.col("key").alias("path"), "length", "segment_id")
    files = store.checksums(data).join(data.select("path", "segment_id"), "path")
    return L.checksum_mismatches(files, store.read_manifests(spark, path)[0]).select("segment_id")


def _offer(batches):
    """Copy archive objects into a drop zone, some of them broken by the number of their rows."""
    for batch in batches:
        for row in batch.itertuples():
            files, name = store.open_uri(row.key)
            system, target = store.open_uri(row.target)
            size, length = row.row_count, files.get_file_info(name).size
            system.create_dir(target.rpartition("/")[0], recursive=True)
            with files.open_input_stream(name) as stream:
                if row.kind == "manifest":
                    document = json.loads(stream.read())
                    document["manifest_version"] = 2 if size % 11 == 0 else 1
                    document["parquet_sha256"] = "0" if size % 7 == 0 else document["parquet_sha256"].upper()
                    with system.open_output_stream(f"{target}.manifest.json") as out:
                        out.write(json.dumps(document).encode())
                    continue
                left = 4 if size % 13 == 0 else length - 4 if size % 5 == 0 else length
                with system.open_output_stream(f"{target}.parquet") as out:
                    while left:
                        chunk = stream.read(min(left, 1 << 20))
                        left -= len(chunk)
                        out.write(chunk)
                    if size % 5 == 0 and size % 13:
                        out.write(b"xxxx")
            if size % 17:
                with system.open_output_stream(f"{target}.ready") as out:
                    out.write(b"")
        yield batch[["key"]]


def _drop_zone(spark, sf):
    """Real eight-hour segments offered for import; some are broken in one way or another."""
    zone = scratch_path(spark, "drop")
    rows = window_stats(T.logs(spark, sf), "8h").select(F.col("id").alias("segment_id"), "row_count")
    objects = store.list_archive(spark, SQ.archived(spark, sf, "8h")).join(rows, "segment_id")
    offered = objects.select("key", "kind", "row_count", F.concat(F.lit(f"{zone}/segment-"), "segment_id").alias("target"))
    checkpointed(offered.repartition("key").mapInPandas(_offer, "key string"))
    return zone


_IMPORTS = """imports AS (SELECT *, CASE WHEN row_count % 13 = 0 THEN 'file too small'
    WHEN row_count % 5 = 0 THEN 'missing footer magic' WHEN row_count % 11 = 0 THEN 'unsupported manifest_version 2'
    WHEN row_count % 7 = 0 THEN 'checksum mismatch'
    WHEN id IN (SELECT id FROM segs) THEN 'segment already exists' END AS error
  FROM (SELECT strftime(time_bucket(INTERVAL '8 hours', timestamp), '%Y%m%d%H%M') AS id, count(*) AS row_count,
    min(timestamp) AS time_start, max(timestamp) AS time_end FROM logs GROUP BY 1) WHERE row_count % 17 <> 0)"""
_ALL_IMPORTS = _IMPORTS.replace(" WHERE row_count % 17 <> 0", "")


def _validated(spark, sf):
    return store.validate_imports(store.read_imports(spark, _drop_zone(spark, sf)), T.segs(spark, sf))


def _import_ready(spark, sf):
    ready = store.ready_imports(store.list_folder(spark, _drop_zone(spark, sf)))
    return ready.select("stem", *[F.regexp_extract(c, "([^/]*)$", 1).alias(c) for c in ("data", "manifest")])


def _import_validate(spark, sf):
    return _validated(spark, sf).select(F.regexp_extract("stem", "segment-(.*)", 1).alias("id"), "error")


def _import_writes(spark, sf):
    """What lies in the folder of accepted imports and in the quarantine."""
    good, bad = scratch_path(spark, "accepted"), scratch_path(spark, "quarantine")
    store.write_imports(_validated(spark, sf), good, bad)
    stem = F.regexp_extract("stem", "segment-(.*)", 1).alias("id")
    reason = F.lit(None).cast("string").alias("error")
    return spark.read.json(good).select(stem, reason).unionAll(spark.read.json(bad).select(stem, "error"))


def _import_rows(spark, sf):
    accepted, _ = store.split_imports(_validated(spark, sf))
    rows = L.imported_rows(accepted.select("manifest.*"), T.NOW, _TTL, False, "/data/rehydrated")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end", "rehydrated_at", "evict_after")}
    return rows.withColumns(times).select(
        "id", "state", "time_start", "time_end", "row_count", "local_path", F.array_join("sources", ",").alias("sources"),
        "rehydrated_at", "evict_after", (F.col("size_bytes") == F.col("size_compressed")).alias("sized"),
        F.length("parquet_sha256").alias("checksum_length"),
    )


def _import_overlap(spark, sf):
    return L.import_overlaps(window_stats(T.logs(spark, sf), "8h"), T.segs(spark, sf)).select("id", "existing_id")


def _archived(spark, sf):
    return L.archived_segments(T.segs(spark, sf)).select("id", "time_end", "archive_ref")


CASES = [
    Case("lif_age", _age, _sql(f"SELECT id, state, time_end FROM local WHERE {_OLD} AND NOT {_KEEP}", _LOCAL)),
    Case("lif_size", _size, _sql("SELECT id FROM over_size WHERE large", _LOCAL, _FREED)),
    Case("lif_protected", _protected, _sql("SELECT id, state, sealed_at, state = 'sealed' AND sealed_at > "
        "TIMESTAMP '2024-01-30 05:30:00' AS protected FROM segs")),
    Case("lif_candidates", _candidates, _sql("SELECT id, state, time_end, size_bytes FROM local", _LOCAL)),
    Case(
        "lif_decide",
        _decide,
        _sql(
            "SELECT id, state, CASE WHEN state = 'sealed' AND archive_ref IS NULL THEN 'archive_then_delete' ELSE 'delete' "
            "END AS action, CASE WHEN state = 'sealed' AND archive_ref IS NULL THEN 'sealed' WHEN state = 'archived' THEN "
            "'archived' WHEN state = 'rehydrated' AND archive_ref IS NOT NULL THEN 'archived' ELSE 'lost' END AS next_state "
            "FROM segs"
        ),
    ),
    Case(
        "lif_plan",
        _plan,
        _sql("SELECT id, state, time_end, size_bytes, reason, action, next_state FROM plan", _LOCAL, _FREED, _PLAN),
    ),
    Case(
        "lif_plan_summary",
        _plan_summary,
        _sql(
            "SELECT (SELECT count(*) FROM local) AS evaluated, count(*) AS selected, "
            "CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM plan",
            _LOCAL,
            _FREED,
            _PLAN,
        ),
    ),
    Case(
        "lif_apply",
        _apply,
        _sql(
            "SELECT s.id, CASE WHEN copied THEN 'archived' WHEN gone THEN p.next_state ELSE s.state END AS state, "
            "CASE WHEN NOT gone THEN s.local_path END AS local_path, CASE WHEN copied THEN concat('copy-', s.id) ELSE "
            "s.archive_ref END AS archive_ref, CASE WHEN NOT gone THEN s.evict_after END AS evict_after FROM "
            "(SELECT segs.*, coalesce(plan.action = 'archive_then_delete' AND row_count % 2 = 0, false) AS copied, "
            "coalesce(plan.action = 'delete' OR (plan.action = 'archive_then_delete' AND row_count % 2 = 0), false) AS gone "
            "FROM segs LEFT JOIN plan USING (id)) s LEFT JOIN plan p ON p.id = s.id",
            _LOCAL,
            _FREED,
            _PLAN,
        ),
    ),
    Case(
        "lif_state",
        _state,
        _sql(
            "SELECT id, CASE last.level WHEN 'error' THEN 'lost' WHEN 'warn' THEN 'archived' ELSE state END AS state, "
            "CASE WHEN last.level <> 'error' THEN local_path END AS local_path, CASE WHEN last.level = 'warn' THEN "
            "concat('ref2-', id) ELSE archive_ref END AS archive_ref, CASE WHEN last.level <> 'error' THEN evict_after END AS "
            "evict_after, row_count FROM segs JOIN (SELECT strftime(time_bucket(INTERVAL '6 hours', timestamp), "
            "'%Y%m%d%H%M') AS id, arg_max(level, event_id) AS level FROM logs GROUP BY 1) last USING (id)"
        ),
    ),
    Case(
        "lif_archive_select",
        _archive_select,
        _sql(
            "SELECT id, time_end, local_path FROM segs WHERE state = 'sealed' AND local_path IS NOT NULL AND "
            "time_end < TIMESTAMP '2024-01-21'"
        ),
    ),
    Case(
        "lif_rehydrate_select",
        _restore_select,
        _sql(
            "SELECT id, state, state = 'rehydrated' AS already_local, size_bytes FROM segs WHERE "
            "time_start <= TIMESTAMP '2024-01-19 09:00:00' AND time_end >= TIMESTAMP '2024-01-06' AND state <> 'lost' AND "
            "(state = 'rehydrated' OR archive_ref IS NOT NULL)"
        ),
    ),
    Case(
        "lif_rehydrate_estimate",
        _restore_estimate,
        _sql(
            "SELECT count(*) AS segments, CAST(sum(size_bytes) * 10000 AS BIGINT) AS total_bytes, "
            "CAST(greatest(1, sum(size_bytes) * 10000 // 52428800) AS BIGINT) AS seconds FROM segs WHERE "
            "time_start <= TIMESTAMP '2024-01-19 09:00:00' AND time_end >= TIMESTAMP '2024-01-06' AND state <> 'lost' AND "
            "(state = 'rehydrated' OR archive_ref IS NOT NULL)"
        ),
    ),
    Case(
        "lif_rehydrate_apply",
        _restore_apply,
        _sql(
            "SELECT id, 'rehydrated' AS state, CASE WHEN state = 'rehydrated' THEN local_path ELSE "
            "concat('/data/rehydrated/segment-', id, '.parquet') END AS local_path, TIMESTAMP '2024-02-03' AS evict_after "
            "FROM segs WHERE time_start <= TIMESTAMP '2024-01-19 09:00:00' AND time_end >= TIMESTAMP '2024-01-06' AND "
            "state <> 'lost' AND (state = 'rehydrated' OR archive_ref IS NOT NULL)"
        ),
    ),
    Case(
        "lif_evict",
        _evict,
        _sql(
            "SELECT id, evict_after, CASE WHEN archive_ref IS NOT NULL THEN 'archived' ELSE 'lost' END AS next_state "
            "FROM segs WHERE state = 'rehydrated' AND evict_after <= TIMESTAMP '2024-01-25'"
        ),
    ),
    Case(
        "lif_evict_apply",
        _evict_apply,
        _sql(
            "SELECT id, CASE WHEN NOT due THEN state WHEN archive_ref IS NOT NULL THEN 'archived' ELSE 'lost' END AS state, "
            "CASE WHEN NOT due THEN local_path END AS local_path, CASE WHEN NOT due THEN evict_after END AS evict_after "
            "FROM (SELECT *, coalesce(state = 'rehydrated' AND evict_after <= TIMESTAMP '2024-01-25', false) AS due FROM segs)"
        ),
    ),
    Case(
        "lif_audit",
        _audit,
        _sql(
            "SELECT id AS segment_id, 'orphan' AS finding FROM segs WHERE n % 7 <> 3 AND n % 11 = 5 UNION ALL "
            "SELECT id, 'dangling' FROM segs WHERE n % 7 = 3 AND n % 11 <> 5 UNION ALL "
            "SELECT id, 'mismatch' FROM segs WHERE n % 7 <> 3 AND n % 11 <> 5 AND n % 13 = 2 UNION ALL "
            "SELECT id, 'missing' FROM segs WHERE n % 7 = 3 AND archive_ref IS NOT NULL"
        ),
    ),
    Case(
        "lif_audit_ids",
        _audit_ids,
        _sql(
            "SELECT id AS segment_id, CASE WHEN n % 11 = 5 THEN 'orphan' WHEN n % 7 = 3 THEN 'dangling' ELSE 'mismatch' END "
            "AS finding, CASE WHEN n % 7 <> 3 THEN concat(strftime(time_start, 'segments/%Y/%m/%d/%H/segment-'), id, '.parquet') END "
            "AS data_key, CASE WHEN n % 11 <> 5 THEN concat(strftime(time_start, 'segments/%Y/%m/%d/%H/segment-'), id, "
            "'.manifest.json') END AS manifest_key FROM segs WHERE "
            "time_start < TIMESTAMP '2024-01-15' AND NOT (n % 7 = 3 AND n % 11 = 5) AND "
            "(n % 11 = 5 OR n % 7 = 3 OR n % 13 = 2)"
        ),
    ),
    Case(
        "lif_checksum",
        _checksum,
        _sql(
            "SELECT id AS segment_id FROM segs WHERE n % 13 = 2 AND n % 7 <> 3 AND n % 11 <> 5"
        ),
    ),
    Case(
        "src_import_ready",
        _import_ready,
        _sql(
            "SELECT concat('segment-', id) AS stem, concat('segment-', id, '.parquet') AS data, "
            "concat('segment-', id, '.manifest.json') AS manifest FROM imports",
            _IMPORTS,
        ),
    ),
    Case(
        "lif_rehydrate_ids",
        _restore_ids,
        _sql(
            "SELECT id, state, state = 'rehydrated' AS already_local FROM segs WHERE strftime(window_start, '%H') IN ('00', '12') "
            "AND window_start >= TIMESTAMP '2024-01-02' AND window_start < TIMESTAMP '2024-01-20' AND state <> 'lost' AND "
            "(state = 'rehydrated' OR archive_ref IS NOT NULL)"
        ),
    ),
    Case(
        "lif_rehydrate_manifest",
        _restore_manifest,
        _sql(
            "SELECT id, CASE WHEN state = 'rehydrated' THEN -1 ELSE row_count END AS row_count, CASE WHEN state = "
            "'rehydrated' THEN coalesce(array_to_string(sources, ','), '') ELSE 'events' END AS sources, "
            "state <> 'rehydrated' AS own_checksum, CASE WHEN state <> 'rehydrated' THEN true WHEN n % 2 = 1 THEN false END "
            "AS own_size FROM segs WHERE time_start <= TIMESTAMP '2024-01-19 09:00:00' AND time_end >= TIMESTAMP '2024-01-06' "
            "AND state <> 'lost' AND (state = 'rehydrated' OR archive_ref IS NOT NULL)"
        ),
    ),
    Case("lif_import_writes", _import_writes, _sql("SELECT id, error FROM imports", _IMPORTS)),
    Case("lif_import_validate", _import_validate, _sql("SELECT id, error FROM imports", _IMPORTS)),
    Case(
        "lif_import_rows",
        _import_rows,
        _sql(
            "SELECT id, 'rehydrated' AS state, time_start, time_end, row_count, "
            "concat('/data/rehydrated/segment-', id, '.parquet') AS local_path, 'events' AS sources, "
            "TIMESTAMP '2024-01-31' AS rehydrated_at, TIMESTAMP '2024-02-03' AS evict_after, true AS sized, "
            "64 AS checksum_length FROM imports WHERE error IS NULL",
            _IMPORTS,
        ),
    ),
    Case(
        "lif_import_overlap",
        _import_overlap,
        _sql(
            "SELECT i.id, s.id AS existing_id FROM imports i JOIN segs s ON i.time_start <= s.time_end AND "
            "s.time_start <= i.time_end AND i.id <> s.id WHERE s.state <> 'lost'",
            _ALL_IMPORTS,
        ),
    ),
    Case(
        "lif_archived",
        _archived,
        _sql("SELECT id, time_end, archive_ref FROM segs WHERE archive_ref IS NOT NULL"),
    ),
]
