"""The hot store: merged beside writers and readers, sealed by batch numbers, listed in tasks."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from timberline.schema import LogSchema
from timberline.sources import compaction, store
from timberline.streaming import ingest as I

T0 = dt.datetime(2026, 5, 12)
DDL = "event_id bigint, timestamp timestamp_ntz, service string, level string, message string, host string, source string, attributes string, raw string"


def batch_rows(number, hours=3, each=4):
    return [
        (number * 100 + h * 10 + i, T0 + dt.timedelta(hours=h, minutes=i), "s", "info", "m", "h", "s", "{}", "{}") for h in range(hours) for i in range(each)
    ]


def arrive(spark, path, number, rows):
    events = spark.createDataFrame(rows, DDL)
    I._write_events(I._placed(events, "1h", LogSchema().bind(events), None), path, number)


def ids(spark, path):
    return sorted(r.event_id for r in store.read_store(spark, path).select("event_id").collect())


@pytest.fixture
def hot(spark, tmp_path):
    path = str(tmp_path / "hot")
    for number in range(6):
        arrive(spark, path, number, batch_rows(number))
    return path


EVERY = sorted(r[0] for n in range(6) for r in batch_rows(n))


def folders(path):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/*/segment_id=202605120100/*"))


def test_rows_are_seen_once_before_during_and_after(spark, hot):
    assert ids(spark, hot) == EVERY
    assert compaction.compact(spark, hot).count() == 3
    assert ids(spark, hot) == EVERY and len(folders(hot)) == 7
    # A second one that is killed before its commit: what it wrote is there, but not seen.
    for number in range(6, 10):
        arrive(spark, hot, number, batch_rows(number))
    now = sorted([*EVERY, *[r[0] for n in range(6, 10) for r in batch_rows(n)]])
    kept = shutil.copytree(f"{hot}-commits", f"{hot}-kept")
    compaction.compact(spark, hot)
    shutil.rmtree(f"{hot}-commits")
    shutil.move(kept, f"{hot}-commits")
    assert ids(spark, hot) == now and "_batch=-2" in folders(hot)
    assert compaction.vacuum(spark, hot) == 15 and ids(spark, hot) == now
    assert "_batch=-2" in folders(hot)  # it might still be running
    # The next one takes a new number, and then the killed one's folder goes.
    assert {r.number for r in compaction.compact(spark, hot).collect()} == {3}
    assert ids(spark, hot) == now
    compaction.vacuum(spark, hot)
    assert folders(hot) == ["_batch=-3", "_batch=9"] and ids(spark, hot) == now
    # A batch that is repeated after it was merged is not seen twice.
    arrive(spark, hot, 3, batch_rows(3))
    assert ids(spark, hot) == now


def test_nothing_to_merge(spark, hot):
    assert compaction.compact(spark, hot, least_folders=9).count() == 0
    assert compaction.vacuum(spark, hot) == 0 and ids(spark, hot) == EVERY


def test_readers_of_before_go_on_beside_a_compaction(spark, hot):
    frame = store.read_store(spark, hot)
    frame.count()
    compaction.compact(spark, hot)
    arrive(spark, hot, 6, batch_rows(6))
    assert sorted(r.event_id for r in frame.collect()) == EVERY  # its files are still there


def restored(hot, kept):
    shutil.rmtree(hot)
    shutil.copytree(kept, hot)


def test_a_late_copy_stays_and_a_repeated_run_adds_nothing(spark, hot, tmp_path):
    path, now = str(tmp_path / "sealed"), T0 + dt.timedelta(hours=2, seconds=90)
    closed = [i for i in EVERY if i % 100 < 20]
    kept = shutil.copytree(hot, f"{hot}-kept")
    store.seal_closed(spark, hot, path, now, "1h")
    assert ids(spark, path) == closed and ids(spark, hot) == [i for i in EVERY if i % 100 >= 20]
    restored(hot, kept)  # the run ended between its commit and the removal
    rows = {r.id: r.row_count for r in store.seal_closed(spark, hot, path, now, "1h").collect()}
    assert ids(spark, path) == closed and rows == {"202605120000": 24, "202605120100": 24}
    arrive(spark, hot, 6, batch_rows(2, 1))  # exact copies of sealed rows, in a batch of their own
    kept = shutil.copytree(hot, f"{hot}-kept-2")
    again = sorted([*closed, *[r[0] for r in batch_rows(2, 1)]])
    store.seal_closed(spark, hot, path, now, "1h")
    assert ids(spark, path) == again
    restored(hot, kept)
    store.seal_closed(spark, hot, path, now, "1h")
    assert ids(spark, path) == again
    assert "_of" not in store.read_store(spark, path).columns


def test_sealing_a_compacted_store(spark, hot, tmp_path):
    """Merged folders seal like others, also when a compaction mixes sealed batches with new ones."""
    path, now = str(tmp_path / "sealed"), T0 + dt.timedelta(hours=2, seconds=90)
    compaction.compact(spark, hot)
    kept = shutil.copytree(hot, f"{hot}-kept")
    store.seal_closed(spark, hot, path, now, "1h")
    closed = [i for i in EVERY if i % 100 < 20]
    assert ids(spark, path) == closed
    restored(hot, kept)
    for number in (6, 7):
        arrive(spark, hot, number, batch_rows(number))
    compaction.compact(spark, hot, least_folders=2)
    store.seal_closed(spark, hot, path, now, "1h")
    assert ids(spark, path) == sorted([*closed, *[r[0] for n in (6, 7) for r in batch_rows(n) if r[0] % 100 < 20]])
    compaction.vacuum(spark, hot)
    assert ids(spark, hot) == sorted(r[0] for n in range(8) for r in batch_rows(n) if r[0] % 100 >= 20)


def test_listing_goes_level_by_level(spark, tmp_path):
    for name in ("a", "x/b", "x/y/c", "x/y/d", "z/e"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "z/empty").write_text("")
    (tmp_path / "nothing").mkdir()
    got = {(os.path.relpath(r.path, tmp_path), r.length) for r in store.list_folder(spark, str(tmp_path)).collect()}
    assert got == {("a", 1), ("x/b", 3), ("x/y/c", 5), ("x/y/d", 5), ("z/e", 3), ("z/empty", 0)}
    assert store.list_folder(spark, str(tmp_path / "nothing")).collect() == []
