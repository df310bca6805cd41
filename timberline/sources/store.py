"""Sealed event store: time-partitioned, time-sorted Parquet and its manifests."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from timberline.functions.timeframe import iso_utc, parse_time, segment_id, segment_start, width_seconds, window_start
from timberline.operators.segments import SEAL_GRACE, sealable, segment_stats
from timberline.schema import EVENT_COLUMNS, LogSchema
from timberline.session import checkpointed

DAY = "dt"
SEGMENT = "segment_id"
ZSTD_LEVEL = "3"
_LISTED = 10_000  # files of a listing batch
_CHUNK = 8 << 20  # bytes of a file in memory
MANIFEST_VERSION = 1

# The fields of a manifest document.
MANIFEST_DDL = (
    "manifest_version int, schema_version int, segment_id string, time_start timestamp, time_end timestamp, "
    "row_count bigint, size_bytes bigint, size_compressed bigint, compression string, compression_level int, "
    "source_names array<string>, parquet_filename string, parquet_sha256 string, persistent boolean"
)


# --- writing -----------------------------------------------------------------


def seal(
    events: DataFrame,
    path: str,
    width: Any = "1h",
    schema: LogSchema = LogSchema(),
    replace: str = "segments",
    max_records_per_file: int = 0,
    segment: Column | None = None,
) -> None:
    """Write events below ``dt=<day>/segment_id=<window>``, sorted by time, zstd level 3.

    ``replace="segments"`` overwrites only the segments that occur in ``events``,
    so sealing a segment again is harmless; ``"all"`` replaces the whole store.
    ``segment`` is the id of the segment that a row goes to, if that is not the window of its time:
    where late rows were placed, say.

    ``rebalance`` brings the rows of a segment together in one shuffle and lets
    AQE split a segment that is much larger than the rest into several files,
    each sorted, and merge small ones; a plain repartition would put a hot
    segment into one task.
    """
    schema = schema.bind(events)
    ts = F.col(schema.timestamp)
    start = window_start(ts, width, schema.ntz) if segment is None else segment_start(segment, schema.ntz)
    placed = events.withColumns({DAY: F.to_date(start), SEGMENT: segment_id(start)})
    order = [DAY, SEGMENT, schema.timestamp, *([schema.id] if schema.id else [])]
    writer = (
        placed.hint("rebalance", F.col(DAY), F.col(SEGMENT))
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if replace == "segments" else "static")
        .partitionBy(DAY, SEGMENT)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
    )
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def read_store(
    spark: SparkSession, path: str, start: Any = None, end: Any = None, width: Any = None, schema: StructType | None = None
) -> DataFrame:
    """Sealed events, optionally only the folders of a time range.

    Days are always bounded by the range, segments too if the store's ``width`` is given.
    Without ``schema`` the columns are taken from the files; the folders' types
    are fixed in any case (``dt`` a date, ``segment_id`` text), so nothing is inferred from
    names. Listing the folders and reading the schema takes longer than a short search:
    keep the frame and use ``prune`` for each query.
    """
    return prune(read_folders(spark, path, schema).drop(BATCH, ORIGIN), start, end, width)


# Folder of a micro-batch in a hot store, and the column that keeps its number where rows were merged or sealed.
BATCH = "_batch"
ORIGIN = "_of"


def raw_folders(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All rows below a store, with ``ORIGIN`` (null where it is not stored) and, in a hot store, ``BATCH``."""
    columns = schema or spark.read.option("basePath", path).parquet(path).schema
    folders = [StructField(DAY, DateType()), StructField(SEGMENT, StringType())]
    batch = [f for f in columns.fields if f.name == BATCH]
    data = [f for f in columns.fields if f.name not in (DAY, SEGMENT, BATCH, ORIGIN)]
    whole = StructType([*data, StructField(ORIGIN, LongType()), *folders, *batch])
    return spark.read.schema(whole).option("basePath", path).parquet(path)


def read_folders(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """``raw_folders`` without what a compaction has replaced or not committed."""
    from timberline.sources.compaction import visible

    rows = raw_folders(spark, path, schema)
    return visible(rows, spark, path) if BATCH in rows.columns else rows


def prune(df: DataFrame, start: Any = None, end: Any = None, width: Any = None) -> DataFrame:
    """Bound the day folders, and with ``width`` the segment folders, by a time range.

    Spark does not derive that from a bound on the event time by itself. Segment ids have a
    fixed width, so they compare as text; the first segment is the one that holds ``start``.
    """
    if start is not None:
        low = parse_time(start)
        df = df.filter(F.col(DAY) >= F.lit(low.date()))
        if width is not None:
            df = df.filter(F.col(SEGMENT) >= F.lit(_id_of(low, width)))
    if end is not None:
        high = parse_time(end)
        df = df.filter(F.col(DAY) <= F.lit(high.date()))
        if width is not None:
            df = df.filter(F.col(SEGMENT) <= F.lit(_id_of(high, width)))
    return df


def _id_of(moment: dt.datetime, width: Any) -> str:
    """Id of the segment that holds a moment."""
    epoch = dt.datetime(1970, 1, 1)
    seconds = width_seconds(width)
    start = epoch + dt.timedelta(seconds=(moment - epoch) // dt.timedelta(seconds=seconds) * seconds)
    return start.strftime("%Y%m%d%H%M")


def seal_closed(
    spark: SparkSession,
    hot: str,
    path: str,
    now: Any,
    width: Any = "1h",
    schema: LogSchema = LogSchema(),
    grace: dt.timedelta = SEAL_GRACE,
) -> DataFrame:
    """Seal the closed windows of a hot store and retire their hot files.

    The hot store is laid out like the sealed one (``append_store``). All windows that
    ended ``grace`` before ``now`` are written sorted, the catalog rows of the sealed
    segments are returned (``id, state, row_count, time_start, time_end, sources,
    sealed_at``), and only then are their hot folders removed. Open windows stay.

    A segment that was sealed before and got late rows is written again with both. Sealed rows keep the number
    of their batch, and a batch that a sealed segment holds is not added to it again: a run that failed between the
    commit and the removal may simply be repeated, and a late copy of a row counts like any other row. (A hot store
    without batches has no such numbers; there, rows that the sealed segment holds already are not added again.)
    """
    from timberline.sources.compaction import remove_folders

    active = read_folders(spark, hot)
    batched = BATCH in active.columns
    if not batched:
        active = active.withColumn(BATCH, F.lit(None).cast("int"))
    active = active.withColumn(ORIGIN, F.coalesce(ORIGIN, BATCH).cast("bigint"))
    columns = [c for c in active.columns if c not in (DAY, SEGMENT, BATCH)]
    found = active.select(F.col(SEGMENT).alias("id"), BATCH, F.lit("active").alias("state")).distinct()
    # The folders read are fixed here: a batch that arrives meanwhile is left for the next run.
    folders = checkpointed(sealable(found, now, width, grace).select(F.col("id").alias(SEGMENT), BATCH))
    closed = folders.select(SEGMENT).distinct()
    read = folders.select(F.col(SEGMENT).alias("_segment"), F.col(BATCH).alias("_number"))
    here = (F.col(SEGMENT) == F.col("_segment")) & F.col(BATCH).eqNullSafe(F.col("_number"))
    chosen = active.join(read, here, "left_semi")
    if folders.isEmpty():
        none = chosen.limit(0).withColumn(SEGMENT, F.lit(""))
        return _catalog_rows(segment_stats(none, SEGMENT, schema.bind(none)), now)
    if _has_files(path):
        known = read_folders(spark, path).join(closed, SEGMENT, "left_semi")
        if batched:
            # Frozen, like all that is read of the sealed segments, before these are replaced.
            held = checkpointed(known.select(F.col(SEGMENT).alias("_segment"), F.col(ORIGIN).alias("_held")).distinct())
            fresh = chosen.join(held, (F.col(SEGMENT) == F.col("_segment")) & (F.col(ORIGIN) == F.col("_held")), "left_anti")
        else:
            # EXCEPT ALL keeps true duplicates of a row, but not those a repeated run brings.
            fresh = chosen.select(*columns, SEGMENT).exceptAll(known.select(*columns, SEGMENT))
        # Segments sealed before are written again with their own rows.
        both = checkpointed(known.select(SEGMENT).distinct().join(fresh.select(SEGMENT).distinct(), SEGMENT, "left_semi"))
        again = known.join(both, SEGMENT, "left_semi").select(columns).unionAll(fresh.join(both, SEGMENT, "left_semi").select(columns))
        again = checkpointed(again)
        chosen = fresh.join(both, SEGMENT, "left_anti")
        if not batched:
            chosen = checkpointed(chosen)
        if not again.isEmpty():
            seal(again, path, width, schema, "segments")
    seal(chosen.select(columns), path, width, schema, "segments")
    sealed = read_store(spark, path).join(closed, SEGMENT, "left_semi")
    rows = checkpointed(_catalog_rows(segment_stats(sealed, SEGMENT, schema.bind(sealed)), now))
    remove_folders(folders, hot)
    return rows


def _catalog_rows(stats: DataFrame, now: Any) -> DataFrame:
    stamp = F.lit(parse_time(now).isoformat(sep=" ")).cast("timestamp_ntz")
    return stats.select(
        "id", F.lit("sealed").alias("state"), "row_count", "time_start", "time_end", "sources", stamp.alias("sealed_at")
    )


def _has_files(path: str) -> bool:
    from pyarrow import fs

    system, root = open_uri(path)
    return system.get_file_info(root).type == fs.FileType.Directory and any(
        not i.base_name.startswith(("_", ".")) for i in system.get_file_info(fs.FileSelector(root))
    )


def union_hot(hot: DataFrame, sealed: DataFrame) -> DataFrame:
    """Active rows and sealed rows as one table."""
    columns = [c for c in hot.columns if c in sealed.columns]
    return hot.select(columns).unionByName(sealed.select(columns))


def conformance(df: DataFrame, required: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """Row count and the required columns the stored files lack."""
    missing = [c for c in required if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(not missing).alias("conforms"),
    )


# --- files and checksums -----------------------------------------------------


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of the files below a folder. The content is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", "true").load(path).select("path", "length")


def open_uri(path: str) -> tuple[Any, str]:
    """File system and name for a path as Spark lists it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            system, name = open_uri(folder)
            infos = system.get_file_info(fs.FileSelector(name))
            for at in range(0, len(infos), _LISTED):
                part = infos[at : at + _LISTED]
                yield pd.DataFrame(
                    {
                        "path": [f"{folder.rstrip('/')}/{i.base_name}" for i in part],
                        "length": [i.size if i.is_file else None for i in part],
                        "folder": [not i.is_file for i in part],
                    }
                ).astype({"length": "Int64"})


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files in a folder and in its subfolders, empty
    files included (Spark's file sources leave those out).

    Tasks list one level of folders after the other, and the folders found are the next level's table, so
    the driver learns nothing but whether there is one. A task lists a folder at a time and passes its files on in
    batches, so a large drop zone should be split over subfolders.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(path.rstrip("/"),)], "path string")
    found = []
    while not level.isEmpty():
        spread = level.repartition(tasks, "path") if found else level
        listed = checkpointed(spread.mapInPandas(_list_folders, "path string, length bigint, folder boolean"))
        found.append(listed.filter(~F.col("folder")).select("path", "length"))
        level = listed.filter("folder").select("path")
    return reduce(DataFrame.unionAll, found)


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, name = open_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def checksums(files: DataFrame) -> DataFrame:
    """SHA-256 of each listed file (``path, length``).

    Files are streamed in 8 MiB pieces inside the tasks, so their size is not
    limited by executor memory (``binaryFile`` content is, and ends at 2 GiB).
    """
    return files.select("path", "length").mapInPandas(_hash_files, "path string, length bigint, sha256 string")


def segment_of_path(path: Column) -> Column:
    return F.regexp_extract(path, f"/{SEGMENT}=([0-9]+)/", 1)


def _one_checksum(parts: Column) -> Column:
    """The checksum of a single file, or one over the checksums of sorted ``parts``."""
    joined = F.sha2(F.array_join(F.transform(parts, lambda p: p["sha256"]), ""), 256)
    return F.when(F.size(parts) == 1, parts[0]["sha256"]).otherwise(joined)


def segment_files(spark: SparkSession, path: str) -> DataFrame:
    """Per segment: files, bytes and one checksum over its sorted file checksums.

    A segment that fits one file has that file's own SHA-256.
    """
    hashed = checksums(list_files(spark, path, "*.parquet")).withColumn(SEGMENT, segment_of_path(F.col("path")))
    parts = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return hashed.groupBy(SEGMENT).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_compressed"), parts.alias("_parts")
    ).select(
        SEGMENT,
        "files",
        "size_compressed",
        _one_checksum(F.col("_parts")).alias("parquet_sha256"),
    )


# --- manifests ---------------------------------------------------------------


def build_manifests(stats: DataFrame, files: DataFrame, persistent: bool = False) -> DataFrame:
    """One manifest row per segment from its statistics and its stored files."""
    size = F.col("size_bytes") if "size_bytes" in stats.columns else F.lit(0)
    return stats.join(files, stats["id"] == files[SEGMENT]).select(
        F.lit(MANIFEST_VERSION).alias("manifest_version"),
        F.lit(1).alias("schema_version"),
        F.col(SEGMENT),
        "time_start",
        "time_end",
        "row_count",
        F.when(size > 0, size).otherwise(F.col("size_compressed")).cast("bigint").alias("size_bytes"),
        "size_compressed",
        F.lit("zstd").alias("compression"),
        F.lit(int(ZSTD_LEVEL)).alias("compression_level"),
        F.col("sources").alias("source_names"),
        F.concat(F.lit("segment-"), F.col(SEGMENT), F.lit(".parquet")).alias("parquet_filename"),
        "parquet_sha256",
        F.lit(persistent).alias("persistent"),
    )


def manifest_json(manifests: DataFrame) -> DataFrame:
    """``segment_id`` and the manifest document as JSON text."""
    fields = [
        iso_utc(F.col(c)).alias(c) if c in ("time_start", "time_end") else F.col(c) for c in manifests.columns
    ]
    return manifests.select(SEGMENT, F.to_json(F.struct(*fields)).alias("document"))


def seal_manifests(
    spark: SparkSession, path: str, schema: LogSchema = LogSchema(), persistent: bool = False
) -> DataFrame:
    """Manifests of everything sealed below ``path``."""
    stored = read_store(spark, path)
    return build_manifests(segment_stats(stored, SEGMENT, schema), segment_files(spark, path), persistent)


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid manifests, and rejected ones with the reason; one document per file."""
    docs = (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", "*.manifest.json")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    )
    return check_manifests(docs)


def check_manifests(docs: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """Split documents into parsed valid manifests and rejects with the first failed rule."""
    parsed = docs.withColumn("_m", F.from_json(document, MANIFEST_DDL))
    broken = F.when(F.try_parse_json(F.col(document)).isNull(), "not valid JSON")
    checked = parsed.withColumn("error", F.coalesce(broken, manifest_error(F.col("_m"))))
    others = [c for c in docs.columns if c != document]
    valid = checked.filter(F.col("error").isNull()).select(*others, "_m.*")
    rejected = checked.filter(F.col("error").isNotNull()).select(*others, document, "error")
    return valid, rejected


def manifest_error(m: Column) -> Column:
    """First rule a parsed manifest breaks, NULL when it is valid."""

    def empty(field: str) -> Column:
        return F.coalesce(m[field], F.lit("")) == ""

    version = F.coalesce(m["manifest_version"], F.lit(0))
    return F.coalesce(
        F.when(version != MANIFEST_VERSION, F.concat(F.lit("unsupported manifest_version "), version.cast("string"))),
        F.when(empty("segment_id"), "missing segment_id"),
        F.when(empty("parquet_sha256"), "missing parquet_sha256"),
        F.when(empty("parquet_filename"), "missing parquet_filename"),
        F.when(m["time_start"].isNull() | m["time_end"].isNull(), "missing time bounds"),
    )


# --- archive layout ----------------------------------------------------------


def archive_key(segment: Column, start: Column, kind: str = "parquet", prefix: str = "") -> Column:
    """Object key of a segment's data or manifest, by the hour of its start."""
    suffix = {"parquet": ".parquet", "manifest": ".manifest.json"}[kind]
    head = prefix.strip("/") + "/" if prefix.strip("/") else ""
    return F.concat(
        F.lit(head + "segments/"),
        F.date_format(start, "yyyy/MM/dd/HH"),
        F.lit("/segment-"),
        segment,
        F.lit(suffix),
    )


def parse_archive_keys(objects: DataFrame, key: str = "key") -> DataFrame:
    """Add ``segment_id`` and ``kind`` taken from object keys; other objects go."""
    name = F.regexp_extract(F.col(key), r"([^/]*)$", 1)
    kind = F.when(F.endswith(name, F.lit(".manifest.json")), "manifest").when(
        F.endswith(name, F.lit(".parquet")), "parquet"
    )
    segment = F.regexp_replace(name, r"^segment-|(\.manifest\.json|(\.part-[0-9]+)?\.parquet)$", "")
    return objects.withColumns({"segment_id": segment, "kind": kind}).filter(F.col("kind").isNotNull())


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Listing of an archive folder: ``key, length, segment_id, kind``."""
    return parse_archive_keys(list_files(spark, path).withColumnRenamed("path", "key"))


def archive_objects(spark: SparkSession, path: str) -> DataFrame:
    """What an audit reads: ``key, segment_id, kind, sha`` of every segment's data (the
    first file and one checksum of all, by content) and manifest (the checksum it states)."""
    data = list_archive(spark, path).filter(F.col("kind") == "parquet")
    hashed = checksums(data.select(F.col("key").alias("path"), "length")).withColumnRenamed("path", "key")
    joined = parse_archive_keys(hashed).groupBy("segment_id").agg(
        F.min("key").alias("key"), _one_checksum(F.array_sort(F.collect_list(F.struct(F.col("key").alias("path"), "sha256")))).alias("sha")
    )
    valid, _ = read_manifests(spark, path)
    stated = valid.select(F.col("path").alias("key"), "segment_id", F.lit("manifest").alias("kind"), F.col("parquet_sha256").alias("sha"))
    return joined.select("key", "segment_id", F.lit("parquet").alias("kind"), "sha").unionByName(stated)


def copy_plan(segments: DataFrame, remote: DataFrame, prefix: str = "") -> DataFrame:
    """What an archive run does per segment: skip, upload or overwrite the data.

    ``remote`` lists data objects as ``segment_id, sha``. The manifest is
    written in every case, after the data: it is the commit marker.
    """
    found = remote.select(F.col("segment_id").alias("id"), F.col("sha").alias("remote_sha"), F.lit(True).alias("_there"))
    there = F.coalesce("_there", F.lit(False))
    remote_sha = F.coalesce("remote_sha", F.lit(""))
    differs = (remote_sha != "") & (F.lower(remote_sha) != F.lower("parquet_sha256"))
    return segments.join(found, "id", "left").select(
        "id",
        F.when(~there, "upload").when(differs, "overwrite").otherwise("skip").alias("data_action"),
        archive_key(F.col("id"), F.col("time_start"), "parquet", prefix).alias("data_key"),
        archive_key(F.col("id"), F.col("time_start"), "manifest", prefix).alias("manifest_key"),
    )


def _copy_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy ``path`` to ``target`` byte by byte; the target appears whole or not at all."""
    for batch in batches:
        digests = []
        for source, target in zip(batch["path"], batch["target"]):
            (read, name), (write, goal) = open_uri(source), open_uri(target)
            folder = goal.rsplit("/", 1)[0]
            write.create_dir(folder, recursive=True)
            draft, digest = f"{folder}/_draft-{uuid.uuid4().hex}", hashlib.sha256()
            with read.open_input_stream(name) as stream, write.open_output_stream(draft) as out:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
                    out.write(chunk)
            write.move(draft, goal)
            digests.append(digest.hexdigest())
        yield batch[["segment_id", "path"]].assign(sha256=digests)


def _write_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for target, document in zip(batch["target"], batch["document"]):
            system, goal = open_uri(target)
            folder = goal.rsplit("/", 1)[0]
            system.create_dir(folder, recursive=True)
            draft = f"{folder}/_draft-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(document.encode())
            system.move(draft, goal)
        yield batch[["segment_id"]]


def write_archive(spark: SparkSession, sealed: str, manifests: DataFrame, path: str, plan: DataFrame | None = None) -> DataFrame:
    """Archive sealed segments below ``path`` in the layout of ``archive_key``.

    The bytes of the sealed files are copied inside tasks and hashed on the way; a
    segment whose copy has another checksum than its manifest states raises, and no manifest of
    the run is written. Then follows one manifest object per segment, the commit marker. Nothing
    else is touched, so a second run repeats nothing that is there. With a
    ``copy_plan`` only the data it uploads or overwrites is copied; manifests are written
    for all segments of the plan. Returns ``segment_id, files, copied``.

    A segment of several files is stored as ``segment-<id>.part-<n>.parquet``.
    """
    root = path.rstrip("/")
    kept = manifests
    if plan is not None:
        kept = kept.join(plan.select(F.col("id").alias(SEGMENT), "data_action"), SEGMENT)
    action = F.col("data_action") if plan is not None else F.lit("upload")
    kept = checkpointed(kept.withColumn("_copy", action != "skip"))
    files = list_files(spark, sealed, "*.parquet").withColumn(SEGMENT, segment_of_path(F.col("path")))
    # A window over one segment's files, which are few.
    whole = Window.partitionBy(SEGMENT)
    number, count = F.row_number().over(whole.orderBy("path")), F.count(F.lit(1)).over(whole)
    part = F.when(number.isNull() | (count == 1), "").otherwise(F.format_string(".part-%05d", number))
    wanted = kept.filter("_copy").select(SEGMENT, "time_start", "parquet_sha256")
    key = archive_key(F.col(SEGMENT), F.col("time_start"))
    named = files.withColumn("_part", part).join(wanted, SEGMENT)
    target = F.concat(F.lit(root + "/"), F.regexp_replace(key, r"\.parquet$", ""), F.col("_part"), F.lit(".parquet"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copied = checkpointed(
        named.select(SEGMENT, "path", target.alias("target")).repartition(tasks, "path")
        .mapInPandas(_copy_files, "segment_id string, path string, sha256 string")
    )
    found = copied.groupBy(SEGMENT).agg(
        F.count(F.lit(1)).alias("files"), _one_checksum(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("sha")
    )
    checked = kept.join(found, SEGMENT, "left")
    wrong = checked.filter("_copy").filter(F.col("sha").isNull() | (F.lower("sha") != F.lower("parquet_sha256")))
    if bad := [r[0] for r in wrong.select(SEGMENT).limit(5).collect()]:
        raise ValueError(f"copies differ from their manifests: segments {bad}")
    documents = manifest_json(kept.select(*manifests.columns)).join(kept.select(SEGMENT, "time_start"), SEGMENT)
    place = F.concat(F.lit(root + "/"), archive_key(F.col(SEGMENT), F.col("time_start"), "manifest"))
    checkpointed(
        documents.select(SEGMENT, "document", place.alias("target")).repartition(tasks, SEGMENT)
        .mapInPandas(_write_documents, "segment_id string")
    )
    return checked.select(SEGMENT, F.coalesce("files", F.lit(0)).alias("files"), F.col("_copy").alias("copied"))


def read_archive_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected manifests of ``write_archive``, one object per segment."""
    return read_manifests(spark, path)


# --- import drop zone --------------------------------------------------------


def ready_imports(files: DataFrame) -> DataFrame:
    """Stems of a drop zone (``path`` listing) that carry a ``.ready`` marker.

    Gives the paths of the data file and the manifest; NULL when one is absent.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    parts = files.select(
        "path",
        F.regexp_extract(name, r"^(.*?)(\.ready|\.parquet|\.manifest\.json)$", 1).alias("stem"),
        F.regexp_extract(name, r"(\.ready|\.parquet|\.manifest\.json)$", 1).alias("suffix"),
    ).filter(F.col("suffix") != "")

    def pick(suffix: str) -> Column:
        return F.max(F.when(F.col("suffix") == suffix, F.col("path")))

    grouped = parts.groupBy("stem").agg(
        pick(".ready").alias("ready"), pick(".parquet").alias("data"), pick(".manifest.json").alias("manifest")
    )
    return grouped.filter(F.col("ready").isNotNull()).drop("ready")


def _magic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads, tails = [], []
        for path, length in zip(batch["path"], batch["length"]):
            system, name = open_uri(path)
            if length < 8:
                heads.append(None)
                tails.append(None)
                continue
            with system.open_input_file(name) as f:
                heads.append(f.read(4).decode("latin-1"))
                f.seek(length - 4)
                tails.append(f.read(4).decode("latin-1"))
        yield batch.assign(head=heads, tail=tails)


def parquet_magic(files: DataFrame) -> DataFrame:
    """First and last four bytes of each file (``path, length``); only those are read."""
    return files.select("path", "length").mapInPandas(
        _magic, "path string, length bigint, head string, tail string"
    )


def read_imports(spark: SparkSession, path: str) -> DataFrame:
    """The ready imports of a drop folder, with what ``validate_imports`` needs."""
    files = list_folder(spark, path)
    ready = ready_imports(files)
    # The listing is tiny but the files are not: spread them over tasks by number,
    # which AQE leaves alone.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = files.join(ready.select(F.col("data").alias("path")), "path", "left_semi").repartition(tasks, "path")
    hashed = parquet_magic(data).join(checksums(data).select("path", "sha256"), "path")
    docs = (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", "*.manifest.json")
        .text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.manifest\.json$", 1).alias("stem"),
            F.from_json("value", MANIFEST_DDL).alias("manifest"),
        )
    )
    return (
        ready.drop("manifest")
        .join(hashed, F.col("data") == F.col("path"), "left")
        .join(docs, "stem", "left")
        .select("stem", "length", "head", "tail", "sha256", "manifest")
    )


def validate_imports(imports: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``error``, the first check an import fails (NULL when accepted).

    ``imports`` has ``length, head, tail`` of the data file, the parsed manifest
    ``manifest``, and ``sha256`` of the data.
    """
    known = catalog.select(F.col("id").alias("_known"))
    joined = imports.join(known, F.col("manifest.segment_id") == F.col("_known"), "left")
    m = F.col("manifest")
    error = F.coalesce(
        F.when(F.col("length").isNull(), "missing data file"),
        F.when(F.col("length") < 8, "file too small"),
        F.when(F.coalesce("head", F.lit("")) != "PAR1", "missing header magic"),
        F.when(F.coalesce("tail", F.lit("")) != "PAR1", "missing footer magic"),
        F.when(m.isNull(), "missing manifest"),
        manifest_error(m),
        F.when(F.lower(F.coalesce("sha256", F.lit(""))) != F.lower(m["parquet_sha256"]), "checksum mismatch"),
        F.when(F.col("_known").isNotNull(), "segment already exists"),
    )
    return joined.withColumn("error", error).drop("_known")


def split_imports(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted imports and rejected ones (with ``error``)."""
    return (
        validated.filter(F.col("error").isNull()).drop("error"),
        validated.filter(F.col("error").isNotNull()),
    )


def write_imports(validated: DataFrame, accepted: str, quarantine: str) -> None:
    """Append accepted imports to one folder and rejected ones, with their reason, to another.

    ``validated`` is frozen first, so both folders come from one and the same check."""
    good, bad = split_imports(checkpointed(validated))
    good.write.mode("append").json(accepted)
    bad.write.mode("append").json(quarantine)
