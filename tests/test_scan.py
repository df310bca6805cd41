"""Scans through the catalog: what is read, seen in the plan's metrics and by spoilt files."""

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators import search as S
from timberline.operators.facets import BUILTIN
from timberline.operators.request import SearchRequest, run
from timberline.operators.segments import segment_stats
from timberline.sources import scan, store

T0 = dt.datetime(2026, 5, 12)
DDL = "event_id bigint, timestamp timestamp_ntz, service string, level string, message string, host string, source string, attributes string, raw string"
HOURS = 60


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """60 segments of 20 rows; segment 40 also holds five rows of hour 2, segment 41 one of hour 50."""
    path = str(tmp_path_factory.mktemp("store"))
    rows = []
    for hour in range(HOURS):
        for i in range(20):
            ts = T0 + dt.timedelta(hours=hour, minutes=i)
            rows.append((hour * 100 + i, ts, f"svc-{i % 3}", "error" if i % 4 == 0 else "info", f"m {i}", "h", "s", "{}", "{}", hour))
    rows += [(90_000 + i, T0 + dt.timedelta(hours=2, minutes=i), "late", "error", "m", "h", "s", "{}", "{}", 40) for i in range(5)]
    rows += [(95_000, T0 + dt.timedelta(hours=50), "early", "error", "m", "h", "s", "{}", "{}", 41)]
    made = spark.createDataFrame(rows, f"{DDL}, hour int")
    segment = F.date_format(F.timestamp_seconds(F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp())) + F.col("hour") * 3600), "yyyyMMddHHmm")
    store.seal(made, path, "1h", segment=segment)
    return path


@pytest.fixture(scope="module")
def catalog(spark, stored):
    rows = segment_stats(store.read_store(spark, stored), "segment_id")
    hour = (F.unix_timestamp(F.to_timestamp("id", "yyyyMMddHHmm")) - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))) / 3600
    state = F.when(hour == 3, "lost").when(hour == 5, "archived").when(hour == 6, "active").otherwise("sealed")
    return rows.select(
        "id", hour.cast("int").alias("hour"), state.alias("state"), "time_start", "time_end", F.when(~hour.isin(3, 5, 6), F.lit("p")).alias("local_path")
    ).cache()


def files_read(df):
    """Files that each scan of a frame opened, from the metrics of the plan that ran."""
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def between(first, last):
    return T0 + dt.timedelta(hours=first), T0 + dt.timedelta(hours=last, minutes=59)


def test_only_the_segments_of_the_range_are_read(spark, stored, catalog):
    frame = store.read_store(spark, stored)
    start, end = between(2, 7)
    rows = S.matching(scan.catalog_scan(frame, catalog, start, end), start=start, end=end)
    got = rows.collect()
    # Hours 2, 4, 6 and 7, and what lies in segment 40; the lost and the archived one are not read.
    assert {r.event_id // 100 for r in got} == {2, 4, 6, 7, 900} and len(got) == 85
    assert files_read(rows) == [5]


def test_newest_segments_alone_are_read(spark, stored, catalog):
    frame = store.read_store(spark, stored)
    rows = scan.catalog_scan(frame, catalog, *between(0, 59), newest=24)
    assert rows.count() == 24 * 20 + 1  # segment 40 starts in hour 2 by its rows, so it is not among them
    counted = rows.groupBy("segment_id").agg(F.count(F.lit(1)))
    assert len(counted.collect()) == 24 and files_read(counted) == [24]
    with pytest.raises(ValueError):
        scan.catalog_scan(frame, catalog, newest=0)


def test_other_folders_may_be_spoilt(spark, stored, catalog, tmp_path):
    import shutil

    path = shutil.copytree(stored, tmp_path / "copy")
    keep = {r.id for r in scan.readable_segments(catalog, *between(10, 12)).collect()}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet") and folder.rpartition("segment_id=")[2] not in keep:
                with open(f"{folder}/{name}", "wb") as file:
                    file.write(b"spoilt")
    frame = store.read_store(spark, str(path), schema=store.read_store(spark, stored).schema)
    assert scan.catalog_scan(frame, catalog, *between(10, 12)).filter("event_id < 90000").count() == 60 + 20
    with pytest.raises(Exception):
        frame.count()


def test_a_large_catalog_is_not_broadcast(spark, stored, catalog, monkeypatch):
    monkeypatch.setattr(scan, "MOST_BROADCAST", 3)
    frame = store.read_store(spark, stored)
    plan = scan.catalog_scan(frame, catalog, *between(2, 20))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
    assert scan.catalog_scan(frame, catalog, *between(7, 8)).filter("event_id < 4000").count() == 40


def test_a_request_scans_twice_and_counts_what_it_scanned(spark, stored, catalog):
    frame = store.read_store(spark, stored)
    start, end = between(2, 7)
    ask = SearchRequest(start, end, where=P.leaf("service", "eq", "late"), limit=3, facets=BUILTIN)
    answer = run(frame, ask, catalog=catalog)
    page, cursor = answer.rows()
    assert [r.event_id for r in page] == [90_004, 90_003, 90_002] and cursor is not None
    # Five segments are looked into; only one of them has a hit.
    assert tuple(answer.stats.first()) == (3, 5 * 20 + 5, 5)
    assert answer.count.first()["count"] == 5
    assert {(r.facet, r.value, r["count"], r.sample_segments) for r in answer.facets.collect()} >= {("service", "late", 5, 1), ("level", "error", 5, 1)}
    assert len(files_read(answer.page)) == 1
    for part in (answer.count, answer.facets, answer.stats):
        part.collect()
        assert files_read(part) == []  # all read from one frozen aggregate
    second = run(frame, replace(ask, cursor=cursor), catalog=catalog)
    assert tuple(second.stats.first()) == (2, 105, 5) and second.count.first()["count"] == 5
    capped = run(frame, replace(ask, count_guard=4), catalog=catalog).count.first()
    assert tuple(capped) == (3, False, 3)


def test_a_sample_restricts_the_facets_alone(spark, stored, catalog):
    start, end = between(20, 30)
    ask = SearchRequest(start, end, facets=BUILTIN[:2], max_span=None)
    answer = run(store.read_store(spark, stored), ask, catalog=catalog, sample=2)
    assert answer.count.first()["count"] == 11 * 20
    counts = answer.facets.groupBy("facet").agg(F.sum("count").alias("n"), F.max("sample_segments").alias("s")).collect()
    assert {(r.facet, r.n, r.s) for r in counts} == {("service", 40, 2), ("level", 40, 2)}
    with pytest.raises(ValueError):
        run(store.read_store(spark, stored), ask, sample=2)


def test_nothing_in_range(spark, stored, catalog):
    ask = SearchRequest(T0 - dt.timedelta(days=3), T0 - dt.timedelta(days=2), facets=BUILTIN)
    answer = run(store.read_store(spark, stored), ask, catalog=catalog)
    assert answer.rows() == ([], None) and answer.facets.collect() == []
    assert tuple(answer.stats.first()) == (0, 0, 0) and answer.count.first()["count"] == 0
