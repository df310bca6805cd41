import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from timberline.functions import timeframe as TF
from timberline.operators import segments as SG
from timberline.schema import LogSchema

T0 = dt.datetime(2026, 5, 12, 13, 0)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_widths_and_ids(spark):
    assert [TF.width_seconds(w) for w in ("5m", "1h", 7200, dt.timedelta(hours=24))] == [300, 3600, 7200, 86400]
    for bad in ("1m", "7h", "48h", "x", 301):
        with pytest.raises(ValueError):
            TF.width_seconds(bad)
    rows = [(dt.datetime(2026, 5, 12, 13, 47, 59, 999999),), (dt.datetime(1969, 12, 31, 23, 59, 59, 1),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = df.select(TF.segment_id(TF.window_start(F.col("t"), "1h")).alias("id")).collect()
    assert [r.id for r in got] == ["202605121300", "196912312300", None]
    back = spark.createDataFrame([("202605121300",), ("x",), ("202613121300",)], "id string")
    assert [r[0] for r in back.select(TF.segment_start(F.col("id"))).collect()] == [T0, None, None]


def test_placement(spark):
    now = hours(2) + dt.timedelta(seconds=30)
    rows = [(i, t) for i, t in enumerate([hours(2), hours(1.5), hours(0.5), hours(5)])]
    got = SG.place_events(spark.createDataFrame(rows, "i int, timestamp timestamp_ntz"), now, "1h").orderBy("i").collect()
    assert [(r.placement, r.segment_id, r.intended_segment) for r in got] == [
        ("on_time", "202605121500", None),
        ("on_time", "202605121400", None),  # still within the grace
        ("late", "202605121500", "202605121300"),
        ("future", "202605121500", "202605121800"),
    ]


def test_reconcile(spark):
    def ids(*x):
        return spark.createDataFrame([(i,) for i in x], "id string")

    catalog = spark.createDataFrame(
        [("a", "active"), ("b", "active"), ("c", "sealed"), ("d", "sealed"), ("e", "archived"), ("f", "active")], "id string, state string"
    )
    rows = SG.reconcile(ids("a", "n", "b", "x"), ids("b", "c", "m", "x"), catalog).collect()
    assert {r.id: (r.action, r.orphan_active) for r in rows} == {
        "a": ("keep", False),
        "b": ("mark_lost", True),  # its active file is an orphan, so an active row has no file
        "c": ("keep", False),
        "d": ("mark_lost", False),
        "e": ("keep", False),
        "f": ("mark_lost", False),
        "n": ("register_active", False),
        "m": ("register_sealed", False),
        "x": ("register_sealed", True),
    }


def test_overlap_join_against_all_pairs(spark):
    """Long, touching, nested and identical intervals; one day holds most of them."""
    rnd = random.Random(1)

    def intervals(n):
        out = []
        for i in range(n):
            start = hours(rnd.choice([0, 0, 0, rnd.randint(-100, 400)]))
            out.append((f"s{i}", start, start + dt.timedelta(hours=rnd.choice([0, 1, 6, 24, 24 * 90]))))
        return out

    left, right = intervals(60), intervals(80)
    ddl = "id string, time_start timestamp_ntz, time_end timestamp_ntz"
    joined = SG.overlap_join(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl))
    got = sorted((r.id, r.right_id) for r in joined.collect())
    assert got == sorted((a, b) for a, s, e in left for b, s2, e2 in right if s <= e2 and s2 <= e)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lists_empty_windows_sealable_totals(spark):
    rows = [
        ("202605121300", "active", hours(0), hours(0.9), 5, 100, None, ["a"]),
        ("202605121400", "sealed", hours(1), hours(1.9), 5, 100, 10, ["a", "b"]),
        ("202605121600", "lost", hours(3), hours(3.9), 5, 100, 0, []),
    ]
    ddl = "id string, state string, time_start timestamp_ntz, time_end timestamp_ntz, row_count bigint, size_bytes bigint, size_compressed bigint, sources array<string>"
    segs = spark.createDataFrame(rows, ddl)
    page, total = SG.list_segments(segs, source="a")
    assert [r.id for r in page.collect()] == ["202605121400", "202605121300"] and total.first().total == 2
    assert [r.id for r in SG.list_segments(segs, start=hours(1.5), limit=1, offset=1)[0].collect()] == ["202605121400"]
    with pytest.raises(ValueError):
        SG.list_segments(segs, limit=0)
    assert [r.id for r in SG.empty_windows(segs, hours(0), hours(4), "1h").collect()] == ["202605121500"]
    assert SG.sealable(segs, hours(1) + dt.timedelta(seconds=59), "1h").count() == 0
    assert [r.id for r in SG.sealable(segs, hours(1) + dt.timedelta(seconds=60), "1h").collect()] == ["202605121300"]
    found = SG.overlapping(segs, TF.time_literal(hours(0.9)), TF.time_literal(hours(9))).collect()
    assert sorted(r.id for r in found) == ["202605121300", "202605121400"]
    assert {r.state: (r.segments, r.bytes) for r in SG.totals_by_state(segs).collect()} == {
        "active": (1, 100), "sealed": (1, 10), "lost": (1, 100)
    }


def test_stats(spark):
    rows = [(hours(0.2), "b", "xé"), (hours(0.1), "a", "x"), (hours(1.5), "a", None)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, source string, raw string")
    got = {r.id: (r.row_count, r.time_start, r.time_end, r.sources, r.size_bytes) for r in SG.window_stats(df, "1h", LogSchema(), "raw").collect()}
    assert got == {
        "202605121300": (2, hours(0.1), hours(0.2), ["a", "b"], 4),
        "202605121400": (1, hours(1.5), hours(1.5), ["a"], None),
    }
