import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.functions.timeframe import segment_id, window_start
from timberline.operators import search as S
from timberline.operators.facets import BUILTIN
from timberline.operators.ordering import with_prefix
from timberline.operators.request import SearchRequest, run

BASE = dt.datetime(2026, 5, 12)


def frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "event_id bigint, timestamp timestamp_ntz, service string, level string, host string, source string, "
        "message string, raw string, attributes string",
    )


@pytest.fixture(scope="module")
def logs(spark):
    """250 rows, ten per timestamp, a third without service."""
    rows = [
        (i, BASE + dt.timedelta(milliseconds=i // 10), None if i % 3 == 0 else f"svc-{i % 5}", "info", "h", "s", f"msg-{i}", "{}", None)
        for i in range(250)
    ]
    return frame(spark, rows).repartition(5).cache()


@pytest.mark.parametrize(
    "sort",
    [None, [("timestamp", "asc")], [("service", "asc"), ("timestamp", "desc")], [("service", "desc")], [("host", "asc"), ("service", "desc")]],
)
def test_page_walk_covers_every_row_once(logs, sort):
    order = S.sort_order(sort)
    seen, cursor = [], None
    while True:
        page = S.search_page(logs, sort=sort, limit=60, cursor=cursor).orderBy(*order).collect()
        seen += [r.event_id for r in page]
        cursor = S.next_cursor(page, sort)
        if cursor is None:
            break
    assert seen == [r.event_id for r in logs.orderBy(*order).collect()]
    paged = S.paginate(logs, 60, sort=sort).orderBy("row_no").collect()
    assert [r.event_id for r in paged] == seen
    assert [r.page for r in paged] == [i // 60 + 1 for i in range(250)]


def test_limits_and_checks(logs):
    assert S.search(logs).count() == 100
    assert S.page_limit(None) == 100 and S.page_limit(5000) == 5000
    with pytest.raises(ValueError):
        S.page_limit(0)
    for bad in ([("message", "asc")], [("timestamp", "up")]):
        with pytest.raises(ValueError):
            S.search(logs, sort=bad)
    with pytest.raises(ValueError):
        S.search(logs, cursor={"timestamp": BASE})
    with pytest.raises(ValueError):
        S.search(logs, start="2026-05-01", end="2026-05-30")


def test_counts(logs):
    assert S.count_rows(logs).first()["count"] == 250
    assert tuple(S.count_capped(logs, guard=101).first()) == (100, False, 100)
    assert tuple(S.count_capped(logs, guard=251).first()) == (250, True, None)
    assert tuple(S.count_capped(logs, guard=250).first()) == (249, False, 249)
    days = logs.withColumn("dt", F.to_date("timestamp"))
    low, high = (str(t) for t in logs.agg(F.min("timestamp"), F.max("timestamp")).first())
    ask = dict(day="dt", start=low, end=high, max_span=None)
    assert S.count_newest(days, guard=101, **ask) == (100, False)
    assert S.count_newest(days, guard=300, **ask) == (250, True)


def test_shape(logs):
    row = S.shape_events(logs).filter("event_id = 0").first()
    assert row.timestamp == "2026-05-12T00:00:00.000000Z" and row.attributes == "{}" and row.service is None


def test_newest_first_equals_search(spark):
    rows = [
        (i, BASE - dt.timedelta(hours=5 * i), "a", "error" if i % 4 == 0 else "info", "h", "s", "m", "{}", "{}")
        for i in range(200)
    ]
    df = frame(spark, rows).withColumn("dt", F.to_date("timestamp"))
    for limit in (1, 7, 40, 1000):
        ask = dict(start=BASE - dt.timedelta(days=50), end=BASE, where=P.leaf("level", "eq", "error"), limit=limit, max_span=None)
        want = [r.event_id for r in S.search(df, **ask).collect()]
        assert [r.event_id for r in S.search_newest(df, "dt", **ask).collect()] == want


def test_prefix_matches_a_plain_window(spark):
    """A third of the rows share one key; NULL keys and NULL values included."""
    rows = [(i, None if i % 10 == 0 else (0 if i % 3 == 0 else i % 17), None if i % 7 == 0 else i) for i in range(1, 900)]
    df = spark.createDataFrame(rows, "id bigint, k int, v bigint").repartition(6)
    got = with_prefix(df, [F.col("k").asc_nulls_first(), F.col("id").desc()], number="n", sums={"v": "before"}).collect()
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    want, total = {}, 0
    for n, (i, _, v) in enumerate(rows, 1):
        want[i] = (n, total)
        total += v or 0
    assert {r.id: (r.n, r.before) for r in got} == want


def test_whole_request(logs):
    ask = SearchRequest(
        start=BASE, end=BASE + dt.timedelta(seconds=1), where=P.leaf("service", "exists"), limit=30, facets=BUILTIN[:2]
    )
    segment = segment_id(window_start(F.col("timestamp"), "1h"))
    answer = run(logs, ask, segment=segment)
    rows, cursor = answer.rows()
    assert len(rows) == 30 and cursor["event_id"] == rows[-1].event_id
    total = logs.filter("service is not null").count()
    assert answer.count.first()["count"] == total
    assert answer.facets.groupBy("facet").agg(F.sum("count").alias("n")).filter("facet = 'service'").first().n == total
    assert tuple(answer.stats.first()) == (30, 250, 1)
    nxt, _ = run(logs, replace(ask, cursor=cursor)).rows()
    assert not {r.event_id for r in nxt} & {r.event_id for r in rows}
    assert run(logs, replace(ask, cursor=cursor)).count.first()["count"] == total
    with pytest.raises(ValueError):
        run(logs, replace(ask, end=BASE))
