import datetime as dt
import glob
import hashlib
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators import lifecycle as L
from timberline.operators.segments import segment_stats
from timberline.schema import LogSchema
from timberline.sources import ndjson as N
from timberline.sources import store

NOW = dt.datetime(2026, 5, 13)


@pytest.fixture(scope="module")
def logs(spark):
    """30,000 events over two days; a third fall into one hour."""
    second = F.when(F.col("id") % 3 == 0, F.col("id") % 3600).otherwise((F.col("id") * 97) % 172_800)
    return spark.range(30_000).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1778544000) + second).cast("timestamp_ntz").alias("timestamp"),
        F.lit("api").alias("service"),
        F.lit("info").alias("level"),
        F.concat(F.lit("message "), F.sha2(F.col("id").cast("string"), 256)).alias("message"),
        F.lit("h").alias("host"),
        F.concat(F.lit("src-"), (F.col("id") % 2).cast("string")).alias("source"),
        F.lit("{}").alias("attributes"),
        F.sha2(F.col("id").cast("string"), 512).alias("raw"),
    )


@pytest.fixture(scope="module")
def sealed(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "sealed")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    store.seal(logs, path, "1h")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    return path


def test_seal_is_whole_sorted_and_splits_a_hot_segment(spark, logs, sealed):
    files = {}
    for file in glob.glob(f"{sealed}/dt=*/segment_id=*/*.parquet"):
        times = pq.read_table(file, columns=["timestamp"]).column(0).to_pylist()
        assert times == sorted(times)
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
        files.setdefault(os.path.basename(os.path.dirname(file)), []).append(len(times))
    hot = max(files, key=lambda k: sum(files[k]))
    assert sum(files[hot]) > 10_000 and len(files[hot]) > 1  # one hot segment, several writers
    back = store.read_store(spark, sealed).select(logs.columns)
    assert back.exceptAll(logs).count() == 0 and logs.exceptAll(back).count() == 0


def test_time_range_prunes_day_folders(spark, sealed):
    rows = store.read_store(spark, sealed, "2026-05-13T02:00:00Z", "2026-05-13T04:00:00Z")
    plan = rows.filter(P.time_range("2026-05-13T02:00:00Z", "2026-05-13T04:00:00Z"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in text and "GreaterThanOrEqual(timestamp" in text
    assert {str(r[0]) for r in plan.select("dt").distinct().collect()} == {"2026-05-13"}


def test_checksums_and_manifests(spark, sealed, tmp_path):
    hashed = store.checksums(store.list_files(spark, sealed, "*.parquet")).collect()
    for r in hashed:
        data = open(r.path.removeprefix("file:"), "rb").read()
        assert r.sha256 == hashlib.sha256(data).hexdigest() and r.length == len(data)
    manifests = store.seal_manifests(spark, sealed)
    assert manifests.agg(F.sum("row_count")).first()[0] == 30_000
    one = next(r for r in store.segment_files(spark, sealed).collect() if r.files == 1)
    assert one.parquet_sha256 in {r.sha256 for r in hashed}
    docs = store.manifest_json(manifests).collect()
    for d in docs:
        (tmp_path / f"segment-{d.segment_id}.manifest.json").write_text(d.document)
    (tmp_path / "bad.manifest.json").write_text("{nope")
    (tmp_path / "old.manifest.json").write_text('{"manifest_version":2,"segment_id":"x"}')
    valid, rejected = store.read_manifests(spark, str(tmp_path))
    assert valid.drop("path").exceptAll(manifests.select(valid.drop("path").columns).withColumns(
        {c: F.col(c).cast("timestamp") for c in ("time_start", "time_end")})).count() == 0
    assert valid.count() == len(docs)
    assert {os.path.basename(r.path): r.error for r in rejected.collect()} == {
        "bad.manifest.json": "not valid JSON", "old.manifest.json": "unsupported manifest_version 2"
    }


def test_conformance_and_hot_union(spark, logs, sealed):
    stored = store.read_store(spark, sealed)
    assert tuple(store.conformance(stored).first()) == (30_000, "", True)
    assert tuple(store.conformance(stored.drop("raw", "host")).first()) == (30_000, "host,raw", False)
    assert store.union_hot(logs.limit(5), stored).count() == 30_005


def test_archive_keys_and_copy_plan(spark):
    segs = spark.createDataFrame(
        [("a", dt.datetime(2026, 5, 2, 3, 4), "AA"), ("b", dt.datetime(2026, 5, 2, 3), "bb"), ("c", dt.datetime(2026, 5, 2), "cc"), ("d", dt.datetime(2026, 5, 2), "dd")],
        "id string, time_start timestamp_ntz, parquet_sha256 string",
    )
    remote = spark.createDataFrame([("a", "aa"), ("b", "other"), ("d", None)], "segment_id string, sha string")
    got = {r.id: r for r in store.copy_plan(segs, remote, "/p/").collect()}
    assert {i: r.data_action for i, r in got.items()} == {"a": "skip", "b": "overwrite", "c": "upload", "d": "skip"}
    assert got["a"].data_key == "p/segments/2026/05/02/03/segment-a.parquet"
    assert got["a"].manifest_key == "p/segments/2026/05/02/03/segment-a.manifest.json"
    keys = spark.createDataFrame([("x/segment-1.parquet",), ("x/segment-1.manifest.json",), ("x/readme.txt",)], "key string")
    assert {(r.segment_id, r.kind) for r in store.parse_archive_keys(keys).collect()} == {("1", "parquet"), ("1", "manifest")}


def objects_of(path):
    return {f[len(path) :]: (os.stat(f).st_mtime_ns, open(f, "rb").read()) for f in glob.glob(f"{path}/**/segment-*", recursive=True)}


def test_archive_holds_the_sealed_bytes_and_all_manifests(spark, sealed, tmp_path):
    """Half of the segments, then the rest, then one spoilt copy again: nothing else is touched."""
    path = str(tmp_path / "archive")
    manifests = store.seal_manifests(spark, sealed)
    segs = manifests.select(F.col("segment_id").alias("id"), "time_start", "parquet_sha256")
    nothing = spark.createDataFrame([], "segment_id string, sha string")
    ids = sorted(r.id for r in segs.collect())
    half = segs.filter(F.col("id").isin(ids[::2]))
    store.write_archive(spark, sealed, manifests, path, store.copy_plan(half, nothing))
    first = objects_of(path)
    assert sum(k.endswith(".manifest.json") for k in first) == len(ids[::2])

    there = store.archive_objects(spark, path).filter("kind = 'parquet'")
    done = store.write_archive(spark, sealed, manifests, path, store.copy_plan(segs, there)).collect()
    assert {r.segment_id for r in done if r.copied} == set(ids[1::2])
    second = objects_of(path)
    assert all(second[k] == v for k, v in first.items() if k.endswith(".parquet"))
    valid, rejected = store.read_archive_manifests(spark, path)
    assert sorted(r.segment_id for r in valid.collect()) == ids and rejected.count() == 0
    sealed_bytes = sorted(open(f, "rb").read() for f in glob.glob(f"{sealed}/dt=*/*/*.parquet"))
    assert sorted(v[1] for k, v in second.items() if k.endswith(".parquet")) == sealed_bytes
    assert any(".part-" in k for k in second)  # the hot segment has several files

    listed = store.list_archive(spark, path)
    assert {r.segment_id for r in listed.collect()} == set(ids)
    objects = store.archive_objects(spark, path)
    assert L.audit_archive(objects, segs.withColumn("archive_ref", F.lit("x"))).count() == 0
    spoilt = next(k for k in second if k.endswith(".parquet") and ".part-" not in k)
    with open(path + spoilt, "ab") as file:
        file.write(b"x")
    found = L.audit_archive(store.archive_objects(spark, path)).collect()
    assert [(r.finding, r.segment_id in spoilt) for r in found] == [("mismatch", True)]
    there = store.archive_objects(spark, path).filter("kind = 'parquet'")
    store.write_archive(spark, sealed, manifests, path, store.copy_plan(segs, there))
    third = objects_of(path)
    assert {k for k in third if k.endswith(".parquet") and third[k][0] != second[k][0]} == {spoilt}
    assert third[spoilt][1] == second[spoilt][1]


def test_archive_refuses_a_copy_that_differs(spark, sealed, tmp_path):
    path = str(tmp_path / "archive")
    manifests = store.seal_manifests(spark, sealed).withColumn("parquet_sha256", F.lit("00"))
    with pytest.raises(ValueError, match="differ"):
        store.write_archive(spark, sealed, manifests, path)
    assert not any(k.endswith(".manifest.json") for k in objects_of(path))


def test_segment_pruning_reads_one_segment(spark, sealed):
    start, end = "2026-05-12T05:10:00Z", "2026-05-12T05:50:00Z"
    rows = store.read_store(spark, sealed, start, end, "1h")
    files = rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert files and all("segment_id=202605120500" in r.f for r in files)
    whole = store.read_store(spark, sealed).filter(P.time_range(start, end))
    assert rows.filter(P.time_range(start, end)).count() == whole.count() > 0


def test_closed_windows_are_sealed_and_retired(spark, logs, tmp_path):
    hot, path = str(tmp_path / "hot"), str(tmp_path / "sealed")
    store.seal(logs, hot, "1h")
    now = "2026-05-12T10:00:30Z"  # the window from 09:00 is still in its grace
    rows = store.seal_closed(spark, hot, path, now, "1h").collect()
    assert {r.id for r in rows} == {f"20260512{h:02d}00" for h in range(9)} and {r.state for r in rows} == {"sealed"}
    left, done = store.read_store(spark, hot), store.read_store(spark, path)
    sealed_rows = done.count()
    assert left.count() + sealed_rows == 30_000 and sum(r.row_count for r in rows) == sealed_rows
    assert left.filter("segment_id < '202605120900'").isEmpty()
    assert store.seal_closed(spark, hot, path, now, "1h").collect() == []
    late = logs.filter("event_id < 3").withColumn("event_id", F.col("event_id") + 100_000)
    store.seal(late, hot, "1h", replace="segments")
    again = store.seal_closed(spark, hot, path, now, "1h").collect()
    assert [r.id for r in again] == sorted({r.id for r in again}) and store.read_store(spark, path).count() == sealed_rows + 3
    store.seal(late, hot, "1h", replace="segments")  # a run that failed before it removed the hot files
    store.seal_closed(spark, hot, path, now, "1h")
    assert store.read_store(spark, path).filter("event_id >= 100000").count() == 3


def test_unsupported_encodings_are_refused(spark, tmp_path):
    (tmp_path / "a.txt.bz2").write_bytes(b"x")
    with pytest.raises(ValueError, match="encoding"):
        N.read_lines(spark, str(tmp_path))


def test_import_drop_zone(spark, logs, tmp_path):
    """Good, known, tampered, truncated, manifest-less, data-less and not-ready imports."""
    drop = tmp_path / "drop"
    drop.mkdir()
    one = str(tmp_path / "one")
    logs.limit(50).coalesce(1).write.parquet(one)
    data = open(glob.glob(f"{one}/*.parquet")[0], "rb").read()

    def put(stem, data=data, sha=None, ready=True, **more):
        doc = dict(manifest_version=1, schema_version=1, segment_id=stem, time_start="2026-05-12T00:00:00Z",
                   time_end="2026-05-12T01:00:00Z", row_count=50, size_bytes=9, size_compressed=0, source_names=["a"],
                   parquet_filename=f"segment-{stem}.parquet", parquet_sha256=sha or hashlib.sha256(data or b"").hexdigest().upper(),
                   persistent=False, **more)
        if data is not None:
            (drop / f"{stem}.parquet").write_bytes(data)
        (drop / f"{stem}.manifest.json").write_text(json.dumps(doc))
        if ready:
            (drop / f"{stem}.ready").write_text("")

    put("good")
    put("known")
    put("tampered", sha="00")
    put("cut", data[:-4])
    put("tiny", b"PAR1")
    put("nodata", None)
    put("waiting", ready=False)
    put("plain")
    os.rename(drop / "plain.manifest.json", drop / "plain.txt")
    known = spark.createDataFrame([("known",)], "id string")
    checked = store.validate_imports(store.read_imports(spark, str(drop)), known)
    assert {r.stem: r.error for r in checked.collect()} == {
        "good": None, "known": "segment already exists", "tampered": "checksum mismatch", "cut": "missing footer magic",
        "tiny": "file too small", "nodata": "missing data file", "plain": "missing manifest",
    }
    accepted, rejected = store.split_imports(checked)
    assert rejected.count() == 6
    row = L.imported_rows(accepted.select("manifest.*"), NOW, dt.timedelta(days=1), False, "/r").first()
    assert (row.id, row.state, row.size_compressed, row.local_path) == ("good", "rehydrated", None, "/r/segment-good.parquet")
    assert row.evict_after == NOW + dt.timedelta(days=1)
    kept = L.imported_rows(accepted.select("manifest.*"), NOW, dt.timedelta(days=1), True, "/r").first()
    assert kept.evict_after is None


def test_accounting(spark):
    lines = spark.createDataFrame([("a", "{}"), ("a", "[1]"), ("b", "x"), ("a", '{"x":1}')], "s string, line string")
    assert {tuple(r) for r in N.accept_skip(lines, F.col("s")).collect()} == {("a", 2, 1), ("b", 0, 1)}


def test_gzip_lines(spark, tmp_path):
    spark.createDataFrame([("x",), ("",), ("y\r",)], "value string").write.option("compression", "gzip").text(str(tmp_path / "z"))
    assert sorted(r.line for r in N.read_lines(spark, str(tmp_path / "z")).collect()) == ["x", "y"]


def test_stats_of_a_store(spark, sealed):
    stats = segment_stats(store.read_store(spark, sealed), "segment_id", LogSchema(), sized="raw")
    assert stats.agg(F.sum("row_count"), F.sum("size_bytes")).first()[:] == (30_000, 30_000 * 128)
