"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators.lifecycle import audit_archive, checksum_mismatches
from timberline.operators.search import search_newest
from timberline.operators.segments import segment_stats
from timberline.plans import extract_queries as EQ
from timberline.plans import tables as T
from timberline.plans.tables import Case
from timberline.session import checkpointed, scratch_path
from timberline.sources import ndjson as N
from timberline.sources import store
from timberline.sources.extract import DEFAULT_MAPPING


def _written_lines(spark, sf, compression=None):
    path = scratch_path(spark, "lines")
    writer = T.ndjson(spark, sf).select("value").write
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
    return path


def _lines(compression=None):
    def run(spark, sf):
        rows = N.read_lines(spark, _written_lines(spark, sf, compression))
        return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    return run


_LINES_SQL = T.with_ctes("SELECT line, count(*) AS n FROM lines GROUP BY 1", T.NDJSON, T.LINES)


def _multi_source(spark, sf):
    """Each user's lines arrive at one of two sources, each with its own mapping."""
    path = scratch_path(spark, "sources")
    rows = T.ndjson(spark, sf).join(T.table(spark, sf, "events").select("event_id", "user_id"), "event_id")
    name = F.when(F.col("user_id") % 2 == 0, "app").otherwise("edge")
    rows.select(name.alias("source"), "value").write.partitionBy("source").text(path)
    mappings = {
        "app": DEFAULT_MAPPING,
        "edge": {"timestamp": ["ts"], "level": ["severity"], "message": ["msg", "k"], "service": ["app"], "host": []},
    }
    events = N.read_sources(spark, {n: f"{path}/source={n}" for n in mappings}, mappings, T.INGEST_TIME)
    return events.groupBy("source", "level", "service", "host", "message").agg(F.count(F.lit(1)).alias("n"))


def _sealed(spark, sf, width="6h"):
    path = scratch_path(spark, "store")
    store.seal(T.logs(spark, sf), path, width)
    return path


def _scan(spark, sf):
    start, end = "2024-01-09T03:00:00Z", "2024-01-11T21:00:00Z"
    rows = store.read_store(spark, _sealed(spark, sf), start, end, "6h")
    return rows.filter(P.time_range(start, end)).select("event_id", "timestamp", "service", "level", "segment_id")


def _newest(spark, sf):
    rows = store.read_store(spark, _sealed(spark, sf))
    node = P.all_of(P.leaf("level", "eq", "error"), P.leaf("attributes.k", "gte", 95))
    return search_newest(
        rows, store.DAY, start="2024-01-01T00:00:00Z", end="2024-01-30T12:00:00Z", where=node, max_span=None
    ).select("event_id", "timestamp", "level", "attributes")


def _hot_sealed(spark, sf):
    rows = T.logs(spark, sf)
    boundary = F.lit("2024-01-22 06:00:00").cast("timestamp_ntz")
    path = scratch_path(spark, "store")
    store.seal(rows.filter(F.col("timestamp") < boundary), path, "6h")
    both = store.union_hot(rows.filter(F.col("timestamp") >= boundary), store.read_store(spark, path))
    return both.select("event_id", "timestamp", "service", "level", "message", "host", "source", "attributes", "raw")


def _seal(spark, sf):
    stored = store.read_store(spark, _sealed(spark, sf))
    return segment_stats(stored, "segment_id").join(
        stored.select(F.col("segment_id").alias("id"), store.DAY).distinct(), "id"
    ).select("id", F.col(store.DAY).cast("string").alias("dt"), "row_count", "time_start", "time_end")


def sealed_manifests(spark, sf):
    return store.seal_manifests(spark, _sealed(spark, sf))


def archived(spark, sf, width="6h"):
    """The folder of an archive of the whole log table."""
    sealed, path = _sealed(spark, sf, width), scratch_path(spark, "archive")
    store.write_archive(spark, sealed, checkpointed(store.seal_manifests(spark, sealed)), path)
    return path


def _manifest(spark, sf):
    """Manifests, their sizes and checksums checked against the content of the files."""
    path = _sealed(spark, sf)
    manifests = store.seal_manifests(spark, path)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = content.select(
        store.segment_of_path(F.col("path")).alias("segment_id"), F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha")
    )
    sized = (F.col("size_bytes") == F.col("_size")) & (F.col("size_compressed") == F.col("_size"))
    return manifests.join(files, "segment_id").select(
        "manifest_version",
        "schema_version",
        "segment_id",
        "time_start",
        "time_end",
        "row_count",
        "compression",
        "compression_level",
        F.array_join("source_names", ",").alias("source_names"),
        "parquet_filename",
        sized.alias("sized"),
        (F.col("parquet_sha256") == F.col("_sha")).alias("own_checksum"),
        "persistent",
    )


def _listing(spark, sf):
    listed = store.list_archive(spark, archived(spark, sf))
    return listed.select(F.regexp_extract("key", "(segments/.*)$", 1).alias("key"), "segment_id", "kind")


def _roundtrip(spark, sf):
    """Half of the segments archived, then all, then all again; what the archive then holds."""
    sealed, path = _sealed(spark, sf), scratch_path(spark, "archive")
    manifests = checkpointed(store.seal_manifests(spark, sealed))
    segs = manifests.select(F.col("segment_id").alias("id"), "time_start", "parquet_sha256")
    nothing = spark.createDataFrame([], "segment_id string, sha string")
    half = segs.filter(F.substring("id", 9, 2).isin("00", "12"))
    runs = []
    for wanted in (half, segs, segs):
        there = store.archive_objects(spark, path).filter(F.col("kind") == "parquet") if runs else nothing
        plan = store.copy_plan(wanted, there)
        runs.append(checkpointed(store.write_archive(spark, sealed, manifests, path, plan)))
    objects = checkpointed(store.archive_objects(spark, path))
    findings = audit_archive(objects, segs.withColumn("archive_ref", F.col("id")))
    wrong = checksum_mismatches(
        objects.filter("kind = 'parquet'").select("segment_id", F.col("sha").alias("sha256")),
        objects.filter("kind = 'manifest'").select("segment_id", F.col("sha").alias("parquet_sha256")),
    )
    per_id = objects.groupBy("segment_id").agg(F.count_if(F.col("kind") == "parquet").alias("data"), F.count_if(F.col("kind") == "manifest").alias("manifests"))
    for number, run in enumerate(runs):
        per_id = per_id.join(run.select("segment_id", F.col("copied").alias(f"copied_{number + 1}")), "segment_id", "left")
    bad = findings.select("segment_id").union(wrong.select("segment_id")).groupBy("segment_id").count()
    return per_id.join(bad, "segment_id", "left").withColumn("findings", F.coalesce("count", F.lit(0))).drop("count")


def _unsealed_reconcile(spark, sf):
    """A catalog with gaps, and files that are gone or no segments, after a reconcile."""
    from timberline.operators.segments import apply_reconcile, reconcile

    stored = store.read_store(spark, _sealed(spark, sf))
    stats = segment_stats(stored, "segment_id")
    rows = T.segs(spark, sf)
    catalog = rows.filter(F.col("n") % 4 != 1).select("id", "state", "time_start", "time_end", "row_count", "local_path", "sources", "sealed_at")
    files = rows.filter(F.col("n") % 3 != 0).select("id").unionAll(rows.select(F.concat(F.lit("x"), "id")))
    none = rows.select("id").limit(0)
    return apply_reconcile(catalog, reconcile(none, files, catalog), stats, T.NOW).select(
        "id", "state", "row_count", "time_start", "time_end", "local_path", "sealed_at", F.array_join("sources", ",").alias("sources")
    )


def _conformance(spark, sf):
    return store.conformance(store.read_store(spark, _sealed(spark, sf)))


def _checksum(spark, sf):
    """The checksum streamed in tasks against the one of the whole content."""
    path = _sealed(spark, sf)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = content.select(
        store.segment_of_path(F.col("path")).alias("segment_id"), F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha")
    )
    return store.segment_files(spark, path).join(files, "segment_id").select(
        "segment_id",
        "files",
        (F.col("size_compressed") == F.col("_size")).alias("sized"),
        (F.col("parquet_sha256") == F.col("_sha")).alias("equal"),
    )


_WINDOW = "time_bucket(INTERVAL '6 hours', timestamp)"
_ID = f"strftime({_WINDOW}, '%Y%m%d%H%M')"

CASES = [
    Case("src_ndjson", _lines(), _LINES_SQL),
    Case("src_ndjson_gz", _lines("gzip"), _LINES_SQL),
    Case(
        "src_multi_source",
        _multi_source,
        T.with_ctes(
            "SELECT source, level, service, host, message, count(*) AS n FROM (SELECT 'app' AS source, "
            f"{EQ._LEVEL} AS level, f_service AS service, f_host AS host, f_message AS message FROM fields JOIN events "
            "USING (event_id) WHERE user_id % 2 = 0 UNION ALL SELECT 'edge', CASE lower(json_extract_string(j, '$.severity')) "
            "WHEN 'warning' THEN 'warn' WHEN 'crit' THEN 'error' ELSE 'info' END, nullif(json_extract_string(j, '$.app'), ''), "
            "NULL, coalesce(json_extract_string(j, '$.msg'), json_extract_string(j, '$.k')) FROM docs JOIN events "
            "USING (event_id) WHERE user_id % 2 <> 0) GROUP BY ALL",
            *EQ._CTES,
        ),
    ),
    Case(
        "src_parquet_scan",
        _scan,
        T.with_ctes(
            f"SELECT event_id, timestamp, service, level, {_ID} AS segment_id FROM logs WHERE timestamp BETWEEN "
            "TIMESTAMP '2024-01-09 03:00:00' AND TIMESTAMP '2024-01-11 21:00:00'",
            T.LOGS,
        ),
    ),
    Case(
        "src_hot_sealed_union",
        _hot_sealed,
        T.with_ctes("SELECT * FROM logs", T.LOGS),
    ),
    Case(
        "qry_newest_first",
        _newest,
        T.with_ctes(
            "SELECT event_id, timestamp, level, attributes FROM logs WHERE level = 'error' AND "
            "CAST(json_extract_string(attributes, '$.k') AS DOUBLE) >= 95 AND timestamp BETWEEN TIMESTAMP '2024-01-01' AND "
            "TIMESTAMP '2024-01-30 12:00:00' ORDER BY timestamp DESC, event_id DESC LIMIT 100",
            T.LOGS,
        ),
    ),
    Case(
        "snk_seal",
        _seal,
        T.with_ctes(
            f"SELECT {_ID} AS id, strftime({_WINDOW}, '%Y-%m-%d') AS dt, count(*) AS row_count, min(timestamp) AS time_start, "
            "max(timestamp) AS time_end FROM logs GROUP BY 1, 2",
            T.LOGS,
        ),
    ),
    Case(
        "snk_manifest",
        _manifest,
        T.with_ctes(
            f"SELECT 1 AS manifest_version, 1 AS schema_version, {_ID} AS segment_id, min(timestamp) AS time_start, "
            "max(timestamp) AS time_end, count(*) AS row_count, 'zstd' AS compression, 3 AS compression_level, 'events' AS "
            f"source_names, concat('segment-', {_ID}, '.parquet') AS parquet_filename, true AS sized, true AS "
            "own_checksum, false AS persistent FROM logs GROUP BY ALL",
            T.LOGS,
        ),
    ),
    Case(
        "snk_conformance",
        _conformance,
        T.with_ctes(
            "SELECT count(*) AS row_count, '' AS missing_columns, true AS conforms FROM logs", T.LOGS
        ),
    ),
    Case(
        "seg_checksum",
        _checksum,
        T.with_ctes(f"SELECT {_ID} AS segment_id, 1 AS files, true AS sized, true AS equal FROM logs GROUP BY ALL", T.LOGS),
    ),
    Case(
        "src_archive_listing",
        _listing,
        T.with_ctes(
            "SELECT concat(strftime(time_start, 'segments/%Y/%m/%d/%H/segment-'), id, ending) AS key, id AS segment_id, kind FROM "
            f"(SELECT {_ID} AS id, min(timestamp) AS time_start FROM logs GROUP BY 1), (VALUES ('.parquet', 'parquet'), "
            "('.manifest.json', 'manifest')) kinds(ending, kind)",
            T.LOGS,
        ),
    ),
    Case(
        "snk_archive_roundtrip",
        _roundtrip,
        T.with_ctes(
            "SELECT id AS segment_id, 1 AS data, 1 AS manifests, CASE WHEN first THEN true END AS copied_1, NOT first AS copied_2, "
            f"false AS copied_3, 0 AS findings FROM (SELECT DISTINCT {_ID} AS id, substr({_ID}, 9, 2) IN ('00', '12') AS first FROM logs)",
            T.LOGS,
        ),
    ),
    Case(
        "seg_reconcile_apply",
        _unsealed_reconcile,
        T.with_ctes(
            "SELECT id, CASE WHEN n % 4 = 1 THEN 'sealed' WHEN state = 'sealed' AND n % 3 = 0 THEN 'lost' ELSE state END AS state, "
            "row_count, time_start, time_end, CASE WHEN n % 4 <> 1 AND NOT (state = 'sealed' AND n % 3 = 0) THEN local_path END "
            "AS local_path, CASE WHEN n % 4 = 1 THEN TIMESTAMP '2024-01-31' ELSE sealed_at END AS sealed_at, CASE WHEN n % 4 = 1 "
            "THEN 'events' ELSE coalesce(array_to_string(sources, ','), '') END AS sources FROM segs WHERE n % 4 <> 1 OR n % 3 <> 0",
            T.LOGS,
            T.SEGS,
        ),
    ),
]
