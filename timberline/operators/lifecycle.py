"""Retention, archive, restore, import and audit jobs over the segment catalog.

Everything takes and returns rows of the catalog, one per segment; ``now`` is
always an argument, so a plan can be repeated.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.timeframe import parse_time, time_literal
from timberline.operators.ordering import with_prefix
from timberline.operators.segments import overlap_join, overlapping

LOCAL_STATES = ("sealed", "archived", "rehydrated")
PROTECTED = dt.timedelta(hours=1)
RESTORE_BYTES_PER_SECOND = 50 * 1024 * 1024

@dataclass(frozen=True)
class RetentionPolicy:
    max_age: dt.timedelta | None = None
    max_bytes: int | None = None
    protected: dt.timedelta = PROTECTED
    archive_before_delete: bool = False
    archive_available: bool = False


def _present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _ntz(df: DataFrame, column: str = "time_end") -> bool:
    return str(df.schema[column].dataType) == "TimestampNTZType()"


def _archive_copy(df: DataFrame) -> Column:
    copies = [_present(c) for c in ("remote_url", "archive_ref") if c in df.columns]
    found = copies[0]
    for c in copies[1:]:
        found = found | c
    return F.coalesce(found, F.lit(False))


def local_segments(catalog: DataFrame) -> DataFrame:
    """Segments that hold a local file and that retention may remove."""
    return catalog.filter(_present("local_path") & F.col("state").isin(*LOCAL_STATES))


def is_protected(now: Any, window: dt.timedelta = PROTECTED, ntz: bool = True) -> Column:
    """Sealed so recently that retention must leave it."""
    recent = F.col("sealed_at") > time_literal(parse_time(now) - window, ntz)
    return F.coalesce((F.col("state") == "sealed") & recent, F.lit(False))


def is_too_old(now: Any, max_age: dt.timedelta, ntz: bool = True) -> Column:
    return F.col("time_end") < time_literal(parse_time(now) - max_age, ntz)


def over_size(catalog: DataFrame, max_bytes: int, now: Any, protected: dt.timedelta = PROTECTED) -> DataFrame:
    """Ids of the oldest unprotected segments to drop until the total fits.

    A segment goes when the unprotected bytes older than it do not free enough.
    """
    local = local_segments(catalog).withColumn("_keep", is_protected(now, protected, _ntz(catalog)))
    free = F.when(F.col("_keep"), F.lit(0)).otherwise(F.col("size_bytes"))
    total = local.agg((F.coalesce(F.sum("size_bytes"), F.lit(0)) - F.lit(max_bytes)).alias("_over"))
    ordered = with_prefix(
        local.select("id", "time_end", "_keep", free.alias("_free")),
        [F.col("time_end").asc(), F.col("id").asc()],
        sums={"_free": "_freed"},
    )
    return ordered.filter(~F.col("_keep") & (F.col("_freed") < total.scalar())).select("id")


def decide(catalog: DataFrame, policy: RetentionPolicy) -> dict[str, Column]:
    """Action and next state of a segment that retention selected."""
    copied = _archive_copy(catalog)
    state = F.col("state")
    wants_copy = policy.archive_before_delete and policy.archive_available
    archive_first = (state == "sealed") & ~copied & F.lit(wants_copy)
    return {
        "action": F.when(archive_first, "archive_then_delete").otherwise("delete"),
        "next_state": F.when(archive_first, "sealed")
        .when(state == "archived", "archived")
        .when((state == "rehydrated") & copied, "archived")
        .otherwise("lost"),
    }


def retention_plan(catalog: DataFrame, policy: RetentionPolicy, now: Any) -> DataFrame:
    """Segments to remove with reason, action and next state (a dry run)."""
    ntz = _ntz(catalog)
    local = local_segments(catalog).withColumn("_keep", is_protected(now, policy.protected, ntz))
    old = F.lit(False) if policy.max_age is None else is_too_old(now, policy.max_age, ntz)
    reasons = F.when(old, "age")
    if policy.max_bytes:
        large = over_size(catalog, policy.max_bytes, now, policy.protected).select("id", F.lit(True).alias("_large"))
        local = local.join(large, "id", "left")
        reasons = reasons.when(F.col("_large"), "size")
    return (
        local.filter(~F.col("_keep"))
        .withColumn("reason", reasons)
        .filter(F.col("reason").isNotNull())
        .withColumns(decide(catalog, policy))
        .select("id", "state", "time_end", "size_bytes", "reason", "action", "next_state")
    )


def plan_summary(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    evaluated = local_segments(catalog).agg(F.count(F.lit(1)).alias("evaluated"))
    chosen = plan.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return chosen.select(evaluated.scalar().alias("evaluated"), "selected", "bytes")


def apply_retention(catalog: DataFrame, plan: DataFrame, archived: DataFrame, now: Any) -> DataFrame:
    """Catalog after a plan ran.

    ``archived`` holds the outcome of the copies the plan asked for: ``id, ok,
    archive_ref``. A segment whose copy failed or is missing stays as it was.
    """
    ntz = _ntz(catalog)
    outcome = archived.select("id", F.col("ok").alias("_ok"), F.col("archive_ref").alias("_ref"))
    steps = plan.select("id", F.col("action").alias("_action"), F.col("next_state").alias("_next"))
    joined = catalog.join(steps, "id", "left").join(outcome, "id", "left")
    copied = (F.col("_action") == "archive_then_delete") & F.coalesce("_ok", F.lit(False))
    removed = F.coalesce((F.col("_action") == "delete") | copied, F.lit(False))
    changed = {
        "state": F.when(copied, "archived").when(removed, F.col("_next")).otherwise(F.col("state")),
        "local_path": F.when(~removed, F.col("local_path")),
        "evict_after": F.when(~removed, F.col("evict_after")),
        "archive_ref": F.when(copied, F.coalesce("_ref", "archive_ref")).otherwise(F.col("archive_ref")),
    }
    if "archived_at" in catalog.columns:
        changed["archived_at"] = F.when(copied, time_literal(now, ntz)).otherwise(F.col("archived_at"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns])


def apply_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Catalog with the latest change of each id applied.

    ``changes`` has ``id, version`` and any catalog columns; a NULL means
    "unchanged" except for ``cleared``, an array of columns to set to NULL.
    The latest change is an aggregate, so many changes of one id are reduced
    before the shuffle.
    """
    fields = [c for c in changes.columns if c in catalog.columns and c != "id"]
    cleared = F.col("cleared") if "cleared" in changes.columns else F.array().cast("array<string>")
    packed = F.struct(*[F.col(c) for c in fields], cleared.alias("cleared"))
    latest = changes.groupBy("id").agg(F.max_by(packed, "version").alias("_c"))
    joined = catalog.join(latest, "id", "left")

    def value(c: str) -> Column:
        if c not in fields:
            kept = F.col(c)
        else:
            kept = F.coalesce(F.col(f"_c.{c}"), F.col(c))
        gone = F.coalesce(F.array_contains(F.col("_c.cleared"), c), F.lit(False))
        return F.when(~gone, kept).alias(c)

    return joined.select(*[F.col("id") if c == "id" else value(c) for c in catalog.columns])


def archive_candidates(
    catalog: DataFrame, now: Any = None, older_than: dt.timedelta | None = None, segment: str | None = None
) -> DataFrame:
    """Sealed local segments older than an age, or one given segment."""
    ready = catalog.filter((F.col("state") == "sealed") & _present("local_path"))
    if segment:
        return ready.filter(F.col("id") == segment)
    if older_than is None or older_than <= dt.timedelta(0):
        raise ValueError("older_than must be positive")
    return ready.filter(F.col("time_end") < time_literal(parse_time(now) - older_than, _ntz(catalog)))


def restore_candidates(
    catalog: DataFrame, start: Any = None, end: Any = None, segments: Sequence[str] | None = None
) -> DataFrame:
    """Segments of a range, or the given ones, that can be made local, with ``already_local``."""
    ntz = _ntz(catalog)
    if (start is None) == (segments is None) or (start is None) != (end is None):
        raise ValueError("give a time range or segment ids")
    if segments is not None:
        found = catalog.filter((F.col("state") != "lost") & F.col("id").isin(list(segments)))
    else:
        if parse_time(end) <= parse_time(start):
            raise ValueError("end of the time range must be after its start")
        found = overlapping(catalog, time_literal(start, ntz), time_literal(end, ntz))
    already = (F.col("state") == "rehydrated") & F.coalesce(_present("local_path"), F.lit(False))
    return found.withColumn("already_local", already).filter(F.col("already_local") | _archive_copy(catalog))


def restore_estimate(candidates: DataFrame) -> DataFrame:
    """Segments, bytes and expected seconds (50 MiB/s, at least one second)."""
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return candidates.agg(
        F.count(F.lit(1)).alias("segments"),
        total.cast("bigint").alias("total_bytes"),
        F.greatest(F.lit(1), F.floor(total / F.lit(RESTORE_BYTES_PER_SECOND))).cast("bigint").alias("seconds"),
    )


def apply_restore(
    candidates: DataFrame,
    now: Any,
    ttl: dt.timedelta,
    persistent: bool,
    local_root: str,
    manifests: DataFrame | None = None,
) -> DataFrame:
    """Catalog rows after a restore; local ones only get a new expiry.

    With ``manifests`` a restored row takes its rows, sizes, checksum, time bounds and
    sources from its manifest, which is what describes the copy that was restored.
    """
    ntz = _ntz(candidates)
    expiry = F.lit(None).cast("timestamp_ntz" if ntz else "timestamp")
    if not persistent:
        expiry = time_literal(parse_time(now) + ttl, ntz)
    path = F.concat(F.lit(local_root.rstrip("/") + "/segment-"), F.col("id"), F.lit(".parquet"))
    changed = {
        "state": F.lit("rehydrated"),
        "local_path": F.when(F.col("already_local"), F.col("local_path")).otherwise(path),
        "evict_after": expiry,
    }
    if "rehydrated_at" in candidates.columns:
        changed["rehydrated_at"] = F.when(F.col("already_local"), F.col("rehydrated_at")).otherwise(
            time_literal(now, ntz)
        )
    restored = candidates.withColumns(changed)
    if manifests is None:
        return restored
    stated = {**{c: c for c in ("row_count", "size_bytes", "size_compressed", "parquet_sha256", "time_start", "time_end")}, "sources": "source_names"}
    stated = {c: m for c, m in stated.items() if c in candidates.columns}
    read = manifests.select(F.col("segment_id").alias("_segment"), *[F.col(m).alias(f"_{c}") for c, m in stated.items()])
    fresh = ~F.col("already_local") & F.col("_segment").isNotNull()
    return restored.join(read, F.col("id") == F.col("_segment"), "left").select(
        *[
            F.when(fresh, F.col(f"_{c}").cast(candidates.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in stated else F.col(c)
            for c in restored.columns
        ]
    )


def expired(catalog: DataFrame, now: Any) -> DataFrame:
    """Restored segments past their expiry, with the state they fall back to."""
    due = (F.col("state") == "rehydrated") & (F.col("evict_after") <= time_literal(now, _ntz(catalog)))
    back = F.when(_archive_copy(catalog), "archived").otherwise("lost")
    return catalog.filter(due).withColumn("next_state", back)


def apply_eviction(catalog: DataFrame, now: Any) -> DataFrame:
    """Catalog after every expired restore was dropped."""
    due = F.coalesce(
        (F.col("state") == "rehydrated") & (F.col("evict_after") <= time_literal(now, _ntz(catalog))), F.lit(False)
    )
    back = F.when(_archive_copy(catalog), "archived").otherwise("lost")
    return catalog.select(
        *[
            F.when(due, back).otherwise(F.col(c)).alias(c)
            if c == "state"
            else F.when(~due, F.col(c)).alias(c)
            if c in ("local_path", "evict_after")
            else F.col(c)
            for c in catalog.columns
        ]
    )


def archived_segments(catalog: DataFrame) -> DataFrame:
    """Segments with an archive copy, oldest first."""
    return catalog.filter(_archive_copy(catalog)).orderBy(F.col("time_end").asc(), F.col("id").asc())


def audit_archive(objects: DataFrame, catalog: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Findings over an object listing (``key, segment_id, kind, sha``).

    ``orphan``: data without manifest. ``dangling``: manifest without data.
    ``mismatch``: checksums differ. ``missing``: the catalog expects a copy and
    no data object exists. ``ids`` restricts the audit to some segments.
    """
    if ids is not None:
        wanted = ids.select(F.col("id").alias("segment_id")).distinct()
        objects = objects.join(wanted, "segment_id", "left_semi")
    kind = F.col("kind")

    def pick(column: str, wanted_kind: str) -> Column:
        return F.max(F.when(kind == wanted_kind, F.col(column)))

    per_id = objects.groupBy("segment_id").agg(
        pick("key", "parquet").alias("data_key"),
        pick("key", "manifest").alias("manifest_key"),
        pick("sha", "parquet").alias("data_sha"),
        pick("sha", "manifest").alias("manifest_sha"),
    )
    if catalog is not None:
        expected = archive_holders(catalog)
        if ids is not None:
            expected = expected.join(wanted, "segment_id", "left_semi")
        per_id = per_id.join(expected, "segment_id", "full_outer")
    else:
        per_id = per_id.withColumn("expected", F.lit(False))
    has_data, has_manifest = F.col("data_key").isNotNull(), F.col("manifest_key").isNotNull()
    findings = F.array_compact(
        F.array(
            F.when(has_data & ~has_manifest, "orphan"),
            F.when(has_manifest & ~has_data, "dangling"),
            F.when(
                has_data & has_manifest & (F.lower("data_sha") != F.lower("manifest_sha")),
                "mismatch",
            ),
            F.when(F.coalesce("expected", F.lit(False)) & ~has_data, "missing"),
        )
    )
    return per_id.select(
        "segment_id",
        F.explode(findings).alias("finding"),
        "data_key",
        "manifest_key",
    )


def archive_holders(catalog: DataFrame) -> DataFrame:
    return catalog.filter(_archive_copy(catalog)).select(
        F.col("id").alias("segment_id"), F.lit(True).alias("expected")
    )


def checksum_mismatches(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files whose content hash is not the manifest's: ``segment_id, expected, found``."""
    want = manifests.select("segment_id", F.col("parquet_sha256").alias("expected"))
    have = files.select("segment_id", F.col("sha256").alias("found"))
    return want.join(have, "segment_id").filter(F.lower("expected") != F.lower("found"))


def import_overlaps(imports: DataFrame, catalog: DataFrame) -> DataFrame:
    """Existing segments that share time with an imported one, itself excluded."""
    existing = catalog.filter(F.col("state") != "lost").select("id", "time_start", "time_end")
    pairs = overlap_join(imports.select("id", "time_start", "time_end"), existing, prefix="existing_")
    return pairs.filter(F.col("id") != F.col("existing_id"))


def imported_rows(manifests: DataFrame, now: Any, ttl: dt.timedelta, persistent: bool, local_root: str) -> DataFrame:
    """Catalog rows of accepted imports: restored, expiring unless persistent."""
    ntz = _ntz(manifests)
    keep = F.coalesce(F.col("persistent"), F.lit(False)) | F.lit(persistent)
    expiry = F.when(~keep, time_literal(parse_time(now) + ttl, ntz))
    path = F.concat(F.lit(local_root.rstrip("/") + "/segment-"), F.col("segment_id"), F.lit(".parquet"))
    return manifests.select(
        F.col("segment_id").alias("id"),
        F.lit("rehydrated").alias("state"),
        "time_start",
        "time_end",
        "row_count",
        "size_bytes",
        F.when(F.col("size_compressed") > 0, F.col("size_compressed")).alias("size_compressed"),
        path.alias("local_path"),
        "parquet_sha256",
        F.col("source_names").alias("sources"),
        time_literal(now, ntz).alias("rehydrated_at"),
        expiry.alias("evict_after"),
    )
