import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.functions import timeframe as TF
from timberline.operators.search import matching
from timberline.schema import LogSchema

SCHEMA = LogSchema()
ROWS = [
    # id, timestamp, service, level, message, host, source, attributes, raw
    (1, "2026-05-12 13:30:00", "api", "error", "Beta refused 100%", "host-1", "default",
     '{"user_id":42,"trace":{"id":"abc","slow":true},"latency":"1500","n":null}', '{"a_b":1}'),
    (2, "2026-05-12 13:30:01", "Worker", "info", "alpha a_b ok", None, "default",
     '{"user_id":"42","latency":90,"e":"","l":[],"z":0,"f":false}', '{"m":"RAWONLY"}'),
    (3, "2026-05-12 13:30:02", None, "warn", "gamma", "host-2", "edge", '{"user_id":42.0,"latency":"abc"}', "{}"),
    (4, "2026-05-12 13:30:03", "api", "debug", None, "", "edge", '{"user_id":null,"big":9007199254740993}', "{}"),
    (5, "2026-05-12 13:30:04", "svc", "info", "x", "h", "edge", "{}", "{}"),
]


@pytest.fixture(scope="module")
def logs(spark):
    names = "event_id bigint, ts string, service string, level string, message string, host string, source string, attributes string, raw string"
    rows = spark.createDataFrame(ROWS, names)
    return rows.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts").cache()


def ids(logs, node=None, **more):
    return sorted(r.event_id for r in matching(logs, SCHEMA, where=node, max_span=None, **more).collect())


L = P.leaf


@pytest.mark.parametrize(
    "node, expected",
    [
        (L("service", "eq", "API"), [1, 4]),
        (L("service", "eq", "API", case_sensitive=True), []),
        (L("level", "eq", "ERROR"), [1]),
        (L("service", "neq", "api"), [2, 5]),  # a missing value is neither equal nor different
        (P.none_of(L("service", "eq", "api")), [2, 5]),
        (L("service", "in", ["WORKER", None]), [2, 3]),
        (L("service", "not_in", ["worker", None]), [1, 4, 5]),
        (L("service", "not_in", ["worker"]), [1, 4, 5]),
        (L("message", "contains", "100%"), [1]),
        (L("message", "contains", "%"), [1]),
        (L("message", "contains", "a_b"), [2]),
        (L("message", "starts_with", "BETA"), [1]),
        (L("message", "starts_with", "BETA", case_sensitive=True), []),
        (L("host", "exists"), [1, 3, 4, 5]),
        (L("attributes.n", "exists"), []),  # JSON null does not exist
        (L("attributes.e", "exists"), [2]),
        (L("attributes.l", "exists"), [2]),
        (L("attributes.z", "exists"), [2]),
        (L("attributes.f", "exists"), [2]),
        (L("attributes.trace.id", "eq", "ABC"), [1]),
        (L("attributes.trace.slow", "eq", True), [1]),
        (L("attributes.trace.slow", "eq", "true"), [1]),
        (L("attributes.user_id", "eq", 42), [1, 2, 3]),
        (L("attributes.user_id", "eq", "42"), [1, 2, 3]),
        (L("attributes.user_id", "eq", 42.0), [1, 2, 3]),
        (L("attributes.user_id", "neq", 7), [1, 2, 3]),
        (L("attributes.latency", "neq", 90), [1, 3]),  # text is different from a number
        (P.none_of(L("attributes.user_id", "eq", 42)), []),
        (L("attributes.user_id", "in", [7, 42]), [1, 2, 3]),
        (L("attributes.user_id", "not_in", [7, None]), [1, 2, 3]),
        (L("attributes.big", "eq", 9007199254740993), [4]),
        (L("attributes.big", "eq", 9007199254740992), []),
        (L("attributes.latency", "gt", 1000), [1]),  # "abc" compares with no number
        (L("attributes.latency", "lte", "90"), [2]),
        (L("attributes.latency", "gte", "ab"), [3]),
        (L("timestamp", "gte", "2026-05-12T15:30:02+02:00"), [3, 4, 5]),
        (L("timestamp", "eq", dt.datetime(2026, 5, 12, 13, 30)), [1]),
        (L("timestamp", "in", ["2026-05-12T13:30:00Z", "2026-05-12T13:30:04Z"]), [1, 5]),
        (L("source", "gt", "default"), [3, 4, 5]),
        (P.any_of(P.message_has("gamma"), P.all_of(L("level", "eq", "info"), L("host", "exists"))), [3, 5]),
        ([L("source", "eq", "edge"), L("level", "neq", "warn")], [4, 5]),
    ],
)
def test_leaves_and_groups(logs, node, expected):
    assert ids(logs, node) == expected


def test_free_text(logs):
    assert ids(logs, text="  rawonly ") == [2]
    assert ids(logs, text="REFUSED 100%") == [1]
    assert ids(logs, text=["refused", "beta"]) == [1]
    assert ids(logs, text=["refused", "gamma"]) == []
    assert ids(logs, text="   ") == [1, 2, 3, 4, 5]


def test_wildcards_ranges_lists():
    assert P.wildcard("f", "*") == L("f", "exists")
    assert P.wildcard("f", "ab*") == L("f", "starts_with", "ab")
    assert P.wildcard("f", "a*b?") == L("f", "contains", "ab")
    assert P.wildcard("f", "*ab*") == L("f", "contains", "ab")
    assert P.wildcard("f", "42") == L("f", "eq", 42)
    assert P.between("f", 1, 2) == P.all_of(L("f", "gte", 1), L("f", "lte", 2))
    assert P.between("f", 1, "*", inclusive=False) == L("f", "gt", 1)
    assert P.between("f") == L("f", "exists")
    assert P.one_of("f", [1]) == L("f", "eq", 1)
    assert P.one_of("f", [1, 2]) == L("f", "in", [1, 2])


def test_literal_types():
    assert P.coerce_literal("42") == 42 and isinstance(P.coerce_literal("42"), int)
    assert P.coerce_literal("4.5") == 4.5
    assert P.coerce_literal("99999999999999999999") == 1e20
    assert P.coerce_literal("42", quoted=True) == "42"
    assert P.coerce_literal("web-1") == "web-1"
    assert [P.text_of(v) for v in (True, 5.0, 2.5, "x")] == ["true", "5", "2.5", "x"]


def nested(depth):
    node = L("level", "eq", "info")
    for _ in range(depth):
        node = P.all_of(node)
    return node


def test_tree_checks(logs):
    assert ids(logs, nested(P.MAX_DEPTH)) == [2, 5]
    with pytest.raises(P.FilterTooDeep):
        P.validate(nested(P.MAX_DEPTH + 1))
    bad = [
        {"op": "xor", "children": [L("level", "eq", "x")]},
        {"op": "and", "children": []},
        L("level", "like", "x"),
        L("level", "eq", None),
        L("level", "in", []),
        L("level", "in", "x"),
        {"op": "eq", "value": 1},
        L("nope", "eq", 1),
    ]
    for node in bad:
        with pytest.raises(ValueError):
            P.compile_filter(node, SCHEMA)


def test_time_range_and_presets(logs):
    assert ids(logs, start="2026-05-12T13:30:01Z", end="2026-05-12T13:30:03Z") == [2, 3, 4]
    with pytest.raises(ValueError):
        P.time_range("2026-05-12", "2026-05-12")
    with pytest.raises(ValueError):
        P.time_range("2026-05-01", "2026-05-12", max_span=dt.timedelta(days=7))
    now = dt.datetime(2026, 5, 12, 12)
    assert TF.preset_range("15m", now) == (now - dt.timedelta(minutes=15), now)
    assert TF.preset_range(None, now) == TF.preset_range("1h", now)
    with pytest.raises(ValueError):
        TF.preset_range("?", now)
    assert TF.preset_range("custom", now, "2026-05-01T00:00", "2026-05-02T01:00:00+01:00") == (
        dt.datetime(2026, 5, 1),
        dt.datetime(2026, 5, 2),
    )
    with pytest.raises(ValueError):
        TF.preset_range("custom", now)


def test_time_bound_and_level_reach_the_reader(spark, logs, tmp_path):
    logs.write.parquet(str(tmp_path / "logs"))
    rows = spark.read.parquet(str(tmp_path / "logs"))
    found = matching(rows, SCHEMA, "2026-05-12", "2026-05-13", L("level", "in", ["ERROR", "warn"]))
    plan = found.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "In(level, [error,warn])" in plan
    assert "ReadSchema: struct<event_id:bigint,level:string,timestamp:timestamp_ntz>" in plan
