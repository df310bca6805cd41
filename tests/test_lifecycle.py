import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import lifecycle as L

NOW = dt.datetime(2026, 5, 12, 12)
DAY, HOUR = dt.timedelta(days=1), dt.timedelta(hours=1)
DDL = (
    "id string, state string, time_start timestamp_ntz, time_end timestamp_ntz, row_count bigint, size_bytes bigint, "
    "size_compressed bigint, local_path string, remote_url string, archive_ref string, parquet_sha256 string, "
    "sources array<string>, sealed_at timestamp_ntz, archived_at timestamp_ntz, rehydrated_at timestamp_ntz, evict_after timestamp_ntz"
)
NAMES = [part.split()[0] for part in DDL.replace("array<string>", "array").split(", ")]


def catalog(spark, rows):
    filled = []
    for row in rows:
        base = dict(state="sealed", time_start=NOW - 2 * DAY, time_end=NOW - 2 * DAY, row_count=1, size_bytes=100,
                    local_path="/x", sealed_at=NOW - 2 * DAY, sources=[])
        base.update(row)
        filled.append(tuple(base.get(n) for n in NAMES))
    return spark.createDataFrame(filled, DDL)


def plan(spark, rows, **policy):
    found = L.retention_plan(catalog(spark, rows), L.RetentionPolicy(**policy), NOW).orderBy("time_end", "id").collect()
    return [(r.id, r.reason, r.action, r.next_state) for r in found]


def test_age_and_protection(spark):
    rows = [
        dict(id="old", time_end=NOW - 10 * DAY),
        dict(id="edge", time_end=NOW - 5 * DAY),
        dict(id="fresh", time_end=NOW - 9 * DAY, sealed_at=NOW - HOUR / 2),
        dict(id="gone", time_end=NOW - 9 * DAY, local_path=None),
        dict(id="empty", time_end=NOW - 9 * DAY, local_path=""),
        dict(id="lost", time_end=NOW - 9 * DAY, state="lost"),
        dict(id="reh", time_end=NOW - 9 * DAY, state="rehydrated", archive_ref="r", sealed_at=NOW),
    ]
    assert plan(spark, rows, max_age=5 * DAY) == [
        ("old", "age", "delete", "lost"),
        ("reh", "age", "delete", "archived"),
    ]


def test_actions(spark):
    rows = [
        dict(id="a", time_end=NOW - 9 * DAY),
        dict(id="b", time_end=NOW - 8 * DAY, archive_ref="r"),
        dict(id="c", time_end=NOW - 7 * DAY, state="archived", remote_url="s3://x"),
        dict(id="d", time_end=NOW - 6 * DAY, state="rehydrated"),
    ]
    assert plan(spark, rows, max_age=DAY, archive_before_delete=True, archive_available=True) == [
        ("a", "age", "archive_then_delete", "sealed"),
        ("b", "age", "delete", "lost"),
        ("c", "age", "delete", "archived"),
        ("d", "age", "delete", "lost"),  # no copy to fall back to
    ]
    assert plan(spark, rows, max_age=DAY, archive_before_delete=True)[0][2:] == ("delete", "lost")


def loop(rows, max_age, max_bytes):
    """Oldest first until the total fits; age-selected bytes count as freed."""
    rows = sorted(rows, key=lambda r: (r["time_end"], r["id"]))
    protected = {r["id"] for r in rows if r["sealed_at"] > NOW - HOUR}
    out = {r["id"]: "age" for r in rows if r["id"] not in protected and r["time_end"] < NOW - max_age}
    over = sum(r["size_bytes"] for r in rows) - max_bytes
    for r in rows:
        if over <= 0:
            break
        if r["id"] not in protected:
            out.setdefault(r["id"], "size")
            over -= r["size_bytes"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_size_against_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [
        dict(id=f"{i:03}", size_bytes=rnd.choice([0, 1, 50, 400]), time_end=NOW - rnd.choice([1, 1, 1, 3, 8]) * DAY,
             sealed_at=NOW - rnd.choice([HOUR / 2, DAY]))
        for i in range(60)
    ]
    cap = rnd.choice([10, 2000, 4000, 10**9])
    got = {i: reason for i, reason, _, _ in plan(spark, rows, max_age=5 * DAY, max_bytes=cap)}
    assert got == loop(rows, 5 * DAY, cap)


def test_apply_retention(spark):
    rows = [dict(id=i, time_end=NOW - 9 * DAY) for i in ("ok", "failed", "unknown")] + [
        dict(id="del", time_end=NOW - 9 * DAY, archive_ref="r", evict_after=NOW), dict(id="keep", time_end=NOW)
    ]
    cat = catalog(spark, rows)
    todo = L.retention_plan(cat, L.RetentionPolicy(max_age=DAY, archive_before_delete=True, archive_available=True), NOW)
    outcome = spark.createDataFrame([("ok", True, "new"), ("failed", False, None)], "id string, ok boolean, archive_ref string")
    after = L.apply_retention(cat, todo, outcome, NOW)
    assert after.columns == cat.columns
    got = {r.id: (r.state, r.local_path, r.archive_ref, r.archived_at) for r in after.collect()}
    assert got == {
        "ok": ("archived", None, "new", NOW),
        "failed": ("sealed", "/x", None, None),
        "unknown": ("sealed", "/x", None, None),
        "del": ("lost", None, "r", None),
        "keep": ("sealed", "/x", None, None),
    }


def test_state_changes(spark):
    cat = catalog(spark, [dict(id="a", archive_ref="r", evict_after=NOW), dict(id="b")])
    changes = spark.createDataFrame(
        [("a", 1, "archived", None, []), ("a", 3, "lost", None, ["local_path", "evict_after"]), ("a", 2, "sealed", 9, [])],
        "id string, version int, state string, row_count bigint, cleared array<string>",
    )
    got = {r.id: (r.state, r.local_path, r.evict_after, r.archive_ref, r.row_count) for r in L.apply_changes(cat, changes).collect()}
    assert got == {"a": ("lost", None, None, "r", 1), "b": ("sealed", "/x", None, None, 1)}


def test_archive_selection(spark):
    cat = catalog(spark, [dict(id="a", time_end=NOW - 3 * DAY), dict(id="b", time_end=NOW - DAY), dict(id="c", state="archived")])
    assert [r.id for r in L.archive_candidates(cat, NOW, 2 * DAY).collect()] == ["a"]
    assert [r.id for r in L.archive_candidates(cat, segment="b").collect()] == ["b"]
    with pytest.raises(ValueError):
        L.archive_candidates(cat, NOW, dt.timedelta(0))


def test_restore_and_eviction(spark):
    cat = catalog(
        spark,
        [
            dict(id="local", state="rehydrated", evict_after=NOW - HOUR),
            dict(id="copy", state="archived", archive_ref="r", local_path=None, size_bytes=200 * 2**20),
            dict(id="url", state="archived", remote_url="u", local_path=None),
            dict(id="none", state="archived", local_path=None),
            dict(id="lost", state="lost", archive_ref="r"),
        ],
    )
    picked = L.restore_candidates(cat, NOW - 5 * DAY, NOW)
    assert {r.id: r.already_local for r in picked.collect()} == {"local": True, "copy": False, "url": False}
    assert tuple(L.restore_estimate(picked).first()) == (3, 200 * 2**20 + 200, 4)
    assert L.restore_estimate(picked.filter("id = 'url'")).first().seconds == 1
    got = {r.id: (r.state, r.local_path, r.evict_after, r.rehydrated_at) for r in L.apply_restore(picked, NOW, DAY, False, "/r/").collect()}
    assert got["local"] == ("rehydrated", "/x", NOW + DAY, None)
    assert got["copy"] == ("rehydrated", "/r/segment-copy.parquet", NOW + DAY, NOW)
    assert {r.evict_after for r in L.apply_restore(picked, NOW, DAY, True, "/r").collect()} == {None}
    with pytest.raises(ValueError):
        L.restore_candidates(cat, NOW, NOW)

    cat = catalog(
        spark,
        [
            dict(id="due", state="rehydrated", evict_after=NOW, archive_ref="r"),
            dict(id="due2", state="rehydrated", evict_after=NOW - HOUR),
            dict(id="later", state="rehydrated", evict_after=NOW + HOUR),
            dict(id="forever", state="rehydrated"),
        ],
    )
    assert {r.id: r.next_state for r in L.expired(cat, NOW).collect()} == {"due": "archived", "due2": "lost"}
    after = {r.id: (r.state, r.local_path) for r in L.apply_eviction(cat, NOW).collect()}
    assert after == {"due": ("archived", None), "due2": ("lost", None), "later": ("rehydrated", "/x"), "forever": ("rehydrated", "/x")}


def test_audit(spark):
    objects = spark.createDataFrame(
        [("k1", "a", "parquet", "S"), ("k2", "a", "manifest", "s"), ("k3", "b", "parquet", "x"), ("k4", "b", "manifest", "y"),
         ("k5", "c", "parquet", "x"), ("k6", "d", "manifest", "x")],
        "key string, segment_id string, kind string, sha string",
    )
    cat = catalog(spark, [dict(id=i, archive_ref="r") for i in ("a", "d", "z")])
    got = {(r.segment_id, r.finding) for r in L.audit_archive(objects, cat).collect()}
    assert got == {("b", "mismatch"), ("c", "orphan"), ("d", "dangling"), ("d", "missing"), ("z", "missing")}
    some = spark.createDataFrame([("b",), ("d",)], "id string")
    assert {(r.segment_id, r.finding) for r in L.audit_archive(objects, ids=some).collect()} == {("b", "mismatch"), ("d", "dangling")}


def test_restore_by_id_and_from_manifests(spark):
    known = [
        dict(id="a", state="archived", archive_ref="x", local_path=None),
        dict(id="b", state="lost", archive_ref="x", local_path=None),
        dict(id="c", state="rehydrated", local_path="/c", row_count=3),
    ]
    chosen = L.restore_candidates(catalog(spark, known), segments=["a", "b", "c", "none"])
    assert sorted(r.id for r in chosen.collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        L.restore_candidates(catalog(spark, known))
    manifests = spark.createDataFrame(
        [(i, NOW, NOW, 7, 70, 60, "sha", ["s"]) for i in ("a", "c")],
        "segment_id string, time_start timestamp, time_end timestamp, row_count bigint, size_bytes bigint, "
        "size_compressed bigint, parquet_sha256 string, source_names array<string>",
    )
    got = {r.id: r for r in L.apply_restore(chosen, NOW, dt.timedelta(days=1), False, "/r", manifests).collect()}
    assert (got["a"].row_count, got["a"].size_compressed, got["a"].parquet_sha256, got["a"].sources) == (7, 60, "sha", ["s"])
    assert (got["c"].row_count, got["c"].parquet_sha256, got["c"].local_path) == (3, None, "/c")
