import pytest
from pyspark.sql import functions as F

from timberline.operators import facets as FC
from timberline.schema import LogSchema

SCHEMA = LogSchema(timestamp=None, message=None, raw=None, source=None, id="id", dims=("service", "level"), folded=frozenset())


@pytest.fixture(scope="module")
def logs(spark):
    """A third of the rows share one service; 20 other services; 3,000 distinct ids."""
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("svc-"), F.lpad((F.col("id") % 20).cast("string"), 2, "0"))).alias("service"),
        F.when(F.col("id") < 3, "error").otherwise("info").alias("level"),
        F.concat(F.lit('{"u":'), F.col("id").cast("string"), F.lit("}")).alias("attributes"),
        (F.col("id") % 10).cast("string").alias("seg"),
    )
    return rows.cache()


def brute(logs, column, cap):
    counts = {}
    for r in logs.select(column).collect():
        if r[0] is not None:
            counts[r[0]] = counts.get(r[0], 0) + 1
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    return ranked[:cap], len(ranked)


def test_truncation_and_ties(logs):
    facets = [FC.Facet("service", "service", 5), FC.Facet("level", "level", 10)]
    rows = FC.facet_report(logs, facets, SCHEMA).orderBy("facet", "rank").collect()
    for facet, column in (("service", "service"), ("level", "level")):
        best, total = brute(logs, column, 5)
        got = [r for r in rows if r.facet == facet]
        assert [(r.value, r["count"]) for r in got] == best
        assert {(r.total_values, r.truncated) for r in got} == {(total, total > got[0].cap)}


@pytest.mark.parametrize("cap", [7, 1500])
def test_high_cardinality_facet_with_small_and_large_cap(logs, cap):
    rows = FC.facet_report(logs, [FC.Facet("u", "attributes.u", cap)], SCHEMA).orderBy("rank").collect()
    want = sorted(str(i) for i in range(3000))[:cap]
    assert [r.value for r in rows] == want and rows[0].total_values == 3000 and rows[0].truncated


def test_sample_segments(logs):
    rows = FC.facet_report(logs.filter("id < 5"), [FC.Facet("level", "level", 10)], SCHEMA, F.col("seg")).collect()
    assert {(r.value, r["count"], r.sample_segments) for r in rows} == {("error", 3, 5), ("info", 2, 5)}


def test_report_scans_once(spark, logs, tmp_path):
    logs.write.parquet(str(tmp_path / "f"))
    report = FC.facet_report(spark.read.parquet(str(tmp_path / "f")), [FC.Facet("service", "service", 5), FC.Facet("u", "attributes.u", 5)], SCHEMA)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and "WindowGroupLimit" in plan


def test_selection_and_unknown_fields(logs):
    assert FC.select_facets(FC.BUILTIN, None) == list(FC.BUILTIN)
    assert [f.cap for f in FC.BUILTIN] == [100, 10, 50, 50]
    with pytest.raises(ValueError):
        FC.select_facets(FC.BUILTIN, ["nope"])
    with pytest.raises(ValueError):
        FC.facet_counts(logs, [FC.Facet("x", "nope")], SCHEMA)


def test_suggestions(logs):
    got = [tuple(r) for r in FC.suggest_values(logs, "service", "VC-0", 4, SCHEMA).collect()]
    best, _ = brute(logs, "service", 5)
    assert got == [b for b in best if "vc-0" in b[0]][:4]


def test_definitions(spark):
    custom = spark.createDataFrame(
        [
            ("level", "attributes.lvl", None, 5, "string", "config", 0),
            ("user_id", "attributes.user.id", None, 0, "number", "config", 1),
            ("user_id", "attributes.uid", "Mine", 9, "string", "user", 0),
            ("my.req-id", "attributes.req", " ", None, "date", "user", 1),
        ],
        FC.DEFINITION + ", origin string, seq bigint",
    )
    winners, conflicts = FC.merge_definitions(FC.builtin_definitions(spark).unionByName(custom), 33, {"host": 77})
    got = {r.name: r for r in winners.collect()}
    assert set(got) == {"service", "level", "host", "source", "user_id", "my.req-id"}
    assert (got["user_id"].label, got["user_id"].cap, got["user_id"].value_type, got["user_id"].origin) == ("User Id", 33, "number", "config")
    assert (got["my.req-id"].label, got["my.req-id"].cap, got["my.req-id"].value_type) == ("My Req Id", 33, "string")
    assert got["host"].cap == 77 and got["level"].field == "level"
    assert {(r.name, r.origin, r.hidden_by) for r in conflicts.collect()} == {("level", "config", "builtin"), ("user_id", "user", "config")}
