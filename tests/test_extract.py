import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from timberline.functions.levels import LEVEL_TOKENS, canonical_level, trimmed
from timberline.sources import extract as X
from timberline.sources import ndjson as N

NOW = dt.datetime(2024, 2, 1)


def run(spark, lines, mapping=X.DEFAULT_MAPPING, **more):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    return X.extract(df, mapping, ingest_time=NOW, keep=["i"], **more).orderBy("i").collect()


def one(spark, line, mapping=X.DEFAULT_MAPPING, **more):
    rows = run(spark, [line], mapping, **more)
    assert len(rows) == 1
    return rows[0], json.loads(rows[0].attributes)


def test_full_object(spark):
    line = (
        '{"timestamp":"2026-05-12T13:30:00.123456789Z","level":"INFO","service":"api","host":"web-1",'
        '"message":"hello","user":{"id":7,"tags":["a",1.5]},"ok":true,"none":null}'
    )
    row, attrs = one(spark, line, source="app")
    assert row.timestamp == dt.datetime(2026, 5, 12, 13, 30, 0, 123456)
    assert (row.service, row.level, row.message, row.host, row.source, row.raw) == ("api", "info", "hello", "web-1", "app", line)
    assert attrs == {"user": {"id": 7, "tags": ["a", 1.5]}, "ok": True, "none": None, "ingest_level_original": "INFO"}


def test_lines_that_are_no_object_are_skipped(spark):
    lines = ["[1,2]", "null", "42", '"text"', "not json", '{"a":', "{'a':1}", "", '  {"a":1}', '{"a":1} trailing', "{}"]
    assert [r.i for r in run(spark, lines)] == [8, 9, 10]


@pytest.mark.parametrize(
    "value, expected",
    [
        ('"2026-05-12T13:30:00Z"', dt.datetime(2026, 5, 12, 13, 30)),
        ('"2026-05-12T13:30:00.5+02:00"', dt.datetime(2026, 5, 12, 11, 30, 0, 500000)),
        ('"2026-05-12T13:30:00,25-01:30"', dt.datetime(2026, 5, 12, 15, 0, 0, 250000)),
        ("1704067200", dt.datetime(2024, 1, 1)),
        ("1704067200.9", dt.datetime(2024, 1, 1)),
        ("1704067200123", dt.datetime(2024, 1, 1, 0, 0, 0, 123000)),
        ("999999999999", "far"),
        ("-5", dt.datetime(1969, 12, 31, 23, 59, 55)),
        ('"1704067200"', None),
        ('"2026-05-12"', None),
        ('"2026-05-12T13:30:00"', None),
        ('"2026-05-12 13:30:00Z"', None),
        ('"2026-13-12T13:30:00Z"', None),
        ('"2026"', None),
        ("true", None),
        ("[1704067200]", None),
        ("null", None),
    ],
)
def test_timestamps(spark, value, expected):
    df = spark.createDataFrame([('{"ts":%s}' % value,)], "line string")
    row = X.extract(df, ingest_time=NOW).select(F.year("timestamp").alias("y"), "timestamp", "attributes")
    if expected == "far":
        assert row.select("y").first().y == 33658
        return
    got = row.first()
    attrs = json.loads(got.attributes)
    if expected is None:
        assert got.timestamp == NOW and attrs["ingest_timestamp_fallback"] is True and "ts" in attrs
    else:
        assert got.timestamp == expected and "ts" not in attrs and "ingest_timestamp_fallback" not in attrs


def test_level_table(spark):
    tokens = list(LEVEL_TOKENS) + [" WARN ", "Emerg", "verbose", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = {r.t: r.level for r in df.select("t", canonical_level(trimmed(F.col("t"))).alias("level")).collect()}
    assert len(LEVEL_TOKENS) == 24
    assert {t: got[t] for t in LEVEL_TOKENS} == LEVEL_TOKENS
    assert (got[" WARN "], got["Emerg"], got["verbose"], got[""]) == ("warn", "error", None, None)


def test_levels(spark):
    row, attrs = one(spark, '{"level":" Verbose "}')
    assert row.level == "info" and attrs["ingest_level_unrecognized"] == "Verbose" and "level" not in attrs
    row, attrs = one(spark, '{"level":5}')
    assert row.level == "error" and attrs["ingest_level_original"] == "5"
    row, attrs = one(spark, '{"level":42}')
    assert row.level == "info" and attrs["ingest_level_unrecognized"] == "42"
    for skipped in ("true", "[1]", '{"a":1}', "5.5", "null"):
        row, attrs = one(spark, '{"level":%s,"severity":"err"}' % skipped)
        assert row.level == "error" and "level" in attrs and "severity" not in attrs
    row, attrs = one(spark, '{"a":1}')
    assert row.level == "info" and attrs["ingest_level_fallback"] is True
    row, attrs = one(spark, '{"level":"info"}')
    assert set(attrs) == {"ingest_timestamp_fallback"}


def test_candidate_order_and_kinds(spark):
    row, attrs = one(spark, '{"message":null,"msg":{"b":[1,null,"x"]},"service":7,"app":"w","host":"","hostname":"h"}')
    assert (json.loads(row.message), row.service, row.host) == ({"b": [1, None, "x"]}, "w", "h")
    assert attrs["message"] is None and attrs["service"] == 7 and attrs["host"] == ""
    assert one(spark, '{"message":42}')[0].message == "42"
    assert one(spark, '{"message":false}')[0].message == "false"
    row, attrs = one(spark, '{"message":""}')
    assert row.message is None and "message" not in attrs


def test_nested_paths_are_removed_in_place(spark):
    mapping = {"message": ["meta.msg"], "service": ["meta.svc.name"], "host": ["hosts.1"], "level": ["l.0"], "timestamp": ["a.b"]}
    row, attrs = one(
        spark, '{"meta":{"msg":"x","svc":{"name":"q"},"o":2},"hosts":["a","b"],"l":{"0":"warn"},"a.b":1,"a":{"b":"no"}}', mapping
    )
    assert (row.message, row.service, row.host, row.level) == ("x", "q", "b", "warn")
    assert {k: v for k, v in attrs.items() if not k.startswith("ingest_")} == {
        "meta": {"svc": {}, "o": 2}, "hosts": ["a", "b"], "l": {}, "a.b": 1, "a": {"b": "no"}
    }


def test_markers_replace_equal_keys_and_can_be_renamed(spark):
    row, attrs = one(spark, '{"ingest_level_fallback":"mine","x":1}')
    assert attrs == {"x": 1, "ingest_level_fallback": True, "ingest_timestamp_fallback": True}
    _, attrs = one(spark, '{"level":"Quote \\" and \\\\ here"}', marker="m_")
    assert attrs == {"m_level_unrecognized": 'Quote " and \\ here', "m_timestamp_fallback": True}


def test_duplicate_keys_and_numbers(spark):
    _, attrs = one(spark, '{"a":1,"a":2,"big":123456789012345678901234567890,"e":1e3,"d":1.50}')
    assert (attrs["a"], attrs["big"], attrs["e"], attrs["d"]) == (2, 123456789012345678901234567890, 1000.0, 1.5)


def test_line_splitting(spark, tmp_path):
    data = b'{"a":1}\r\n\n\r\nx\ry\n{"b":2}\r\r\nlast'
    (tmp_path / "in.ndjson").write_bytes(data)
    got = [r.line for r in N.read_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(['{"a":1}', "x\ry", '{"b":2}\r', "last"])


def test_sources_need_a_mapping(spark):
    with pytest.raises(ValueError):
        N.read_sources(spark, {"app": "/nowhere"}, {}, NOW)
    with pytest.raises(ValueError):
        X.extract(spark.createDataFrame([("{}",)], "line string"))
