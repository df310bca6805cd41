"""Search, paging and counting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators import search as S
from timberline.plans import tables as T
from timberline.plans.tables import Case

SHOWN = ["event_id", "timestamp", "service", "level", "host", "message"]
COLS = ", ".join(SHOWN)
_WEEK = dict(start="2024-01-08T00:00:00Z", end="2024-01-15T00:00:00Z")
_WEEK_SQL = "timestamp BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'"
_FLAGSHIP = P.all_of(P.leaf("level", "in", ["warn", "error"]), P.leaf("attributes.k", "gt", 50))
_FLAGSHIP_SQL = "level IN ('warn', 'error') AND CAST(json_extract_string(attributes, '$.k') AS DOUBLE) > 50"


def flagship(spark, sf):
    """Newest warnings and errors with k above 50 in one week."""
    return S.search(T.logs(spark, sf), start=_WEEK["start"], end=_WEEK["end"], where=_FLAGSHIP).select(*SHOWN)


def _with_text(spark, sf):
    return S.search(T.logs(spark, sf), where=P.leaf("level", "eq", "info"), text="click", **_WEEK).select(*SHOWN)


def _sort_multi(spark, sf):
    keys = [("service", "asc"), ("level", "desc"), ("timestamp", "asc")]
    return S.search(T.logs(spark, sf), sort=keys, limit=200).select(*SHOWN)


def _sort_desc_null(spark, sf):
    rows = S.matching(T.logs(spark, sf), where=P.leaf("level", "eq", "error"), **_WEEK)
    return S.search(rows, sort=[("service", "desc"), ("host", "asc")], limit=1000).select(*SHOWN)


def _limit(spark, sf):
    return S.search(T.logs(spark, sf), limit=5000).select(*SHOWN)


def _topk(spark, sf):
    orders = T.table(spark, sf, "orders")
    keys = [("o_orderpriority", "asc"), ("o_orderdate", "desc")]
    return S.search(
        orders, T.ORDER_SCHEMA, where=P.leaf("o_orderstatus", "in", ["f", "p"]), sort=keys, limit=50
    ).select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")


def _page2(spark, sf):
    keys = [("service", "asc"), ("timestamp", "desc")]
    rows = T.logs(spark, sf)
    first = S.search_page(rows, sort=keys, limit=100)
    last = first.orderBy(*S.sort_order(keys)).collect()
    cursor = S.next_cursor(last, keys)
    return S.search(rows, sort=keys, limit=100, cursor=cursor).select(*SHOWN)


def _page2_time(spark, sf):
    rows = T.logs(spark, sf)
    first = S.search_page(rows, where=_FLAGSHIP, limit=40, **_WEEK)
    cursor = S.next_cursor(first.orderBy(*S.sort_order(None)).collect())
    return S.search(rows, where=_FLAGSHIP, limit=40, cursor=cursor, **_WEEK).select(*SHOWN)


def _has_more(spark, sf):
    return S.search_page(T.logs(spark, sf), where=P.leaf("host", "eq", "host-2"), limit=75).select(
        "event_id", "timestamp", "has_more"
    )


def _all_pages(spark, sf):
    return S.paginate(T.logs(spark, sf).select("event_id", "timestamp", "level"), 100).select(
        "event_id", "timestamp", "row_no", "page"
    )


def _count(spark, sf):
    return S.count_rows(S.matching(T.logs(spark, sf), where=P.leaf("level", "eq", "error")))


def _count_capped(spark, sf):
    return S.count_capped(S.matching(T.logs(spark, sf), where=P.leaf("level", "eq", "error")), guard=1001)


def _count_exact(spark, sf):
    return S.count_capped(S.matching(T.logs(spark, sf), where=P.leaf("attributes.k", "lt", 3)))


def _shape(spark, sf):
    rows = T.mixed(spark, sf)
    empty = F.when(F.col("event_id") % 6 != 3, F.col("attributes"))
    return S.shape_events(rows.withColumn("attributes", empty))


CASES = [
    Case(
        "qry_search",
        flagship,
        T.with_ctes(
            f"SELECT {COLS} FROM logs WHERE {_WEEK_SQL} AND {_FLAGSHIP_SQL} ORDER BY timestamp DESC, event_id DESC LIMIT 100",
            T.LOGS,
        ),
    ),
    Case(
        "qry_search_text",
        _with_text,
        T.with_ctes(
            f"SELECT {COLS} FROM logs WHERE {_WEEK_SQL} AND level = 'info' AND (contains(lower(message), 'click') "
            "OR contains(lower(raw), 'click')) ORDER BY timestamp DESC, event_id DESC LIMIT 100",
            T.LOGS,
        ),
    ),
    Case(
        "qry_sort_multi",
        _sort_multi,
        T.with_ctes(
            f"SELECT {COLS} FROM logs ORDER BY service ASC NULLS FIRST, level DESC NULLS LAST, timestamp ASC, "
            "event_id ASC LIMIT 200",
            T.LOGS,
        ),
    ),
    Case(
        "qry_sort_desc",
        _sort_desc_null,
        T.with_ctes(
            f"SELECT {COLS} FROM logs WHERE level = 'error' AND {_WEEK_SQL} ORDER BY service DESC NULLS LAST, "
            "host ASC NULLS FIRST, event_id ASC LIMIT 1000",
            T.LOGS,
        ),
    ),
    Case(
        "qry_limit",
        _limit,
        T.with_ctes(f"SELECT {COLS} FROM logs ORDER BY timestamp DESC, event_id DESC LIMIT 5000", T.LOGS),
    ),
    Case(
        "qry_topk",
        _topk,
        "SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') "
        "ORDER BY o_orderpriority ASC NULLS FIRST, o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50",
    ),
    Case(
        "qry_page2",
        _page2,
        T.with_ctes(
            f"SELECT {COLS} FROM logs ORDER BY service ASC NULLS FIRST, timestamp DESC, event_id DESC LIMIT 100 OFFSET 100",
            T.LOGS,
        ),
    ),
    Case(
        "qry_page2_time",
        _page2_time,
        T.with_ctes(
            f"SELECT {COLS} FROM logs WHERE {_WEEK_SQL} AND {_FLAGSHIP_SQL} "
            "ORDER BY timestamp DESC, event_id DESC LIMIT 40 OFFSET 40",
            T.LOGS,
        ),
    ),
    Case(
        "qry_has_more",
        _has_more,
        T.with_ctes(
            "SELECT event_id, timestamp, (SELECT count(*) FROM logs WHERE host = 'host-2') > 75 AS has_more "
            "FROM logs WHERE host = 'host-2' ORDER BY timestamp DESC, event_id DESC LIMIT 75",
            T.LOGS,
        ),
    ),
    Case(
        "qry_all_pages",
        _all_pages,
        T.with_ctes(
            "SELECT event_id, timestamp, row_no, (row_no + 99) // 100 AS page FROM (SELECT event_id, timestamp, "
            "row_number() OVER (ORDER BY timestamp DESC, event_id DESC) AS row_no FROM logs)",
            T.LOGS,
        ),
    ),
    Case("qry_count", _count, T.with_ctes("SELECT count(*) AS count FROM logs WHERE level = 'error'", T.LOGS)),
    Case(
        "qry_count_capped",
        _count_capped,
        T.with_ctes(
            "SELECT CASE WHEN n >= 1001 THEN CAST(1000 AS BIGINT) ELSE n END AS count, n < 1001 AS exact, "
            "CASE WHEN n >= 1001 THEN CAST(1000 AS BIGINT) END AS lower_bound "
            "FROM (SELECT count(*) AS n FROM logs WHERE level = 'error')",
            T.LOGS,
        ),
    ),
    Case(
        "qry_count_exact",
        _count_exact,
        T.with_ctes(
            "SELECT CASE WHEN n >= 10001 THEN CAST(10000 AS BIGINT) ELSE n END AS count, n < 10001 AS exact, "
            "CASE WHEN n >= 10001 THEN CAST(10000 AS BIGINT) END AS lower_bound FROM (SELECT count(*) AS n FROM logs "
            "WHERE CAST(json_extract_string(attributes, '$.k') AS DOUBLE) < 3)",
            T.LOGS,
        ),
    ),
    Case(
        "qry_event_shape",
        _shape,
        T.with_ctes(
            "SELECT event_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, service, level, message, host, "
            "source, CASE WHEN event_id % 6 <> 3 THEN attributes ELSE '{}' END AS attributes, raw FROM mixed",
            T.LOGS,
            T.MIXED,
        ),
    ),
]
