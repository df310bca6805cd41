import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators.segments import place_events, window_stats
from timberline.schema import LogSchema
from timberline.sources.ndjson import stream_lines
from timberline.sources.store import read_store
from timberline.streaming import deltas
from timberline.streaming import ingest as I
from timberline.streaming import live as V
from timberline.streaming.deltas import finish
from timberline.streaming.ratecap import cap_rate_stream
from timberline.streaming.windows import closed_windows

T0 = dt.datetime(2026, 5, 12)
DDL = "event_id bigint, timestamp timestamp_ntz, service string, level string, message string, host string, source string, attributes string, raw string"


def rows(start, count, step=0.1, level="error"):
    return [
        (i, T0 + dt.timedelta(seconds=round((i - start) * step, 3)), "api", level, f"m {i}", "h", "s", "{}", "{}")
        for i in range(start, start + count)
    ]


class Feed:
    """A folder that fills batch by batch, as a stream."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path / "in")
        os.makedirs(self.path)

    def add(self, batch):
        self.spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(DDL).parquet(self.path)


def test_subscription_needs_a_restriction(spark):
    df = spark.createDataFrame([], DDL)
    for sub in (V.Subscription("x"), V.Subscription("x", text="  ")):
        with pytest.raises(ValueError):
            V.live_filter(df, sub)
    with pytest.raises(ValueError):
        V.fan_out(df, [V.Subscription("x", text="a"), V.Subscription("x", text="b")])


SUBS = [V.Subscription("all", text="m"), V.Subscription("errors", where=P.leaf("level", "eq", "error"))]


def run_capped(feed, out, offsets, cap=7, lateness="10 minutes", files=None):
    stream = feed.stream() if files is None else feed.spark.readStream.schema(DDL).option("maxFilesPerTrigger", files).parquet(feed.path)
    capped = cap_rate_stream(V.fan_out(stream, SUBS), cap, lateness=lateness)
    query = (
        capped.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    )
    finish(query)
    return feed.spark.read.schema(capped.schema).parquet(out), query


def test_cap_holds_across_restarts_and_floods(spark, tmp_path):
    """Every batch is a new start of the query; the state of a window lives on in its checkpoint."""
    feed = Feed(spark, tmp_path)
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    batches = [rows(0, 30), rows(1000, 2000, 0.001, "info"), rows(5000, 40)]
    for batch in batches:
        feed.add(batch)
        passed, _ = run_capped(feed, out, offsets)
    got = passed.groupBy("subscription", "window_start").count().collect()
    matched = V.fan_out(spark.read.schema(DDL).parquet(feed.path), SUBS)
    want = {(r.subscription, r.window_start): (r.delivered, r.dropped) for r in V.drop_stats(matched, 7).collect()}
    assert {(r.subscription, r.window_start): r["count"] for r in got} == {k: v[0] for k, v in want.items()}
    assert sum(a + b for a, b in want.values()) == matched.count()
    first = passed.filter("event_id < 1000 and subscription = 'errors'")
    plain = V.cap_rate(V.fan_out(spark.createDataFrame(batches[0], DDL), SUBS[1:]), 7)
    assert {r.event_id for r in first.collect()} == {r.event_id for r in plain.collect()}


def test_a_repeated_batch_passes_nothing_twice(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    for batch in (rows(0, 30), rows(100, 30, 0.05)):
        feed.add(batch)
        before = sorted(r.event_id for r in run_capped(feed, out, offsets)[0].collect())
    last = max((f for f in os.listdir(f"{offsets}/commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):  # the driver was lost before it noted the last batch
        os.remove(f"{offsets}/commits/{name}")
    assert sorted(r.event_id for r in run_capped(feed, out, offsets)[0].collect()) == before


@pytest.mark.parametrize("batches", [3, 30])
def test_state_of_the_cap_ends_with_the_window(spark, tmp_path, batches):
    """The same rows in few and in many batches; the store never holds more than the open windows."""
    feed = Feed(spark, tmp_path)
    every = rows(0, 600, 0.1)  # a minute, ten rows a second
    size = len(every) // batches
    for i in range(batches):
        feed.add(every[i * size : (i + 1) * size])
    passed, query = run_capped(feed, str(tmp_path / "out"), str(tmp_path / "offsets"), 4, "2 seconds", files=1)
    want = V.cap_rate(V.fan_out(spark.createDataFrame(every, DDL), SUBS), 4)
    assert sorted((r.subscription, r.event_id) for r in passed.collect()) == sorted((r.subscription, r.event_id) for r in want.collect())
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    per_batch = 60 // batches
    # Of either subscription: a number and a timer for the windows of the last batches and of two seconds before them.
    assert max(held) <= 2 * 3 * (2 * per_batch + 4) and held[-1] < 2 * 3 * 6


def test_rows_of_a_closed_window_do_not_pass(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    for batch in (rows(0, 5), rows(100, 900, 1), rows(2000, 3)):
        feed.add(batch)
        passed, _ = run_capped(feed, out, offsets, lateness="2 seconds")
    assert passed.filter("event_id >= 2000").count() == 0


def test_rows_without_a_time_and_large_ids(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(2**60 + 1, None, *["x"] * 7), (None, None, *["m"] * 7), (2**60 + 3, T0, None, "error", *[None] * 5)])
    passed, _ = run_capped(feed, str(tmp_path / "out"), str(tmp_path / "offsets"), 1)
    assert sorted(((r.subscription, r.event_id) for r in passed.collect()), key=str) == [("all", None), ("errors", 2**60 + 3)]


def test_the_cap_needs_its_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        with pytest.raises(RuntimeError):
            cap_rate_stream(V.fan_out(spark.createDataFrame([], DDL), SUBS))
    finally:
        spark.conf.set(name, kept)


def test_late_and_future_events_are_kept_and_marked(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(rows(0, 60, 3600))
    now = T0 + dt.timedelta(hours=30)
    out = str(tmp_path / "out")
    I.run_to_parquet(I.mark_late(feed.stream(), now, "1h"), out, str(tmp_path / "offsets"))
    got = spark.read.parquet(out)
    want = place_events(spark.createDataFrame(rows(0, 60, 3600), DDL), now, "1h")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 60
    assert {r[0] for r in got.select("placement").distinct().collect()} == {"late", "on_time", "future"}


def test_ingest_is_exactly_once_over_restarts(spark, tmp_path):
    source, out, offsets = tmp_path / "lines", str(tmp_path / "store"), str(tmp_path / "offsets")
    source.mkdir()
    for part in range(3):
        lines = [f'{{"ts":{1778544000 + part * 7200 + i},"level":"warn","message":"m{part}-{i}"}}' for i in range(50)] + ["junk", ""]
        (source / f"{part}.ndjson").write_text("\n".join(lines))
        events = I.stream_events(stream_lines(spark, str(source)), source="app", ingest_time=T0)
        I.append_store(events, out, offsets, "1h", available_now=True, writers=2).awaitTermination()
    stored = read_store(spark, out)
    assert stored.count() == 150 and stored.select("message").distinct().count() == 150
    files = stored.groupBy("segment_id").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n")).collect()
    assert {r.segment_id for r in files} == {"202605120000", "202605120200", "202605120400"}
    assert all(r.n <= 2 for r in files)


def test_statistics_count_late_rows(spark, tmp_path):
    """Batches out of order, one of them run twice: sums equal the rows that came in."""
    feed = Feed(spark, tmp_path)
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    subs = [V.Subscription("all", text="m")]
    for batch in (rows(200, 30, 1000), rows(0, 10, 1000), rows(100, 12, 1000)):
        feed.add(batch)
        finish(I.write_window_stats(feed.stream(), f"{out}/stats", f"{offsets}/stats", "1h", LogSchema(), available_now=True))
        finish(V.write_match_counts(V.fan_out(feed.stream(), subs), f"{out}/n", f"{offsets}/n", 3600, available_now=True))
    for name in ("2", ".2.crc"):  # the driver was lost before it noted the last batch
        os.remove(f"{offsets}/stats/commits/{name}")
    finish(I.write_window_stats(feed.stream(), f"{out}/stats", f"{offsets}/stats", "1h", LogSchema(), available_now=True))
    everything = spark.read.schema(DDL).parquet(feed.path)
    got = {r.id: (r.row_count, r.sources) for r in I.read_window_stats(spark, f"{out}/stats").collect()}
    assert got == {r.id: (r.row_count, r.sources) for r in window_stats(everything, "1h").collect()}
    drops = V.read_drop_stats(spark, f"{out}/n", 3)
    assert drops.agg(F.sum(F.col("delivered") + F.col("dropped"))).first()[0] == everything.count() == 52
    want = V.drop_stats(V.fan_out(everything, subs), 3, 3600)
    assert sorted(map(tuple, drops.collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_that_takes_too_long_raises(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(rows(0, 5))
    slow = feed.stream().withColumn("x", F.expr("java_method('java.lang.Thread', 'sleep', 5000L)"))
    with pytest.raises(TimeoutError):
        I.run_to_parquet(slow, str(tmp_path / "out"), str(tmp_path / "offsets"), timeout=1)


def write_lines(folder, number, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{number}.ndjson").write_text("\n".join(lines))


def test_ledger_counts_each_batch_and_source_once(spark, tmp_path, monkeypatch):
    """More batches than a query's progress holds, over restarts, one batch repeated, sums folded on the way."""
    monkeypatch.setattr(deltas, "FOLD", 6)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 5)
    source, out, offsets = tmp_path / "lines", str(tmp_path / "store"), str(tmp_path / "offsets")
    want = {"a": [0, 0], "b": [0, 0]}
    for number in range(26):
        name = "ab"[number % 2]
        good, bad = number % 4 + 1, number % 3
        write_lines(source / f"source={name}", number, ['{"ts":1778544000,"message":"m"}'] * good + ["junk"] * bad + [""])
        want[name] = [want[name][0] + good, want[name][1] + bad]

    def take_in():
        lines = stream_lines(spark, str(source), max_files=1, folder="source")
        finish(I.ingest(lines, f"{out}/events", f"{out}/ledger", offsets, source=F.col("source"), available_now=True))

    take_in()
    last = max((f for f in os.listdir(f"{offsets}/commits") if f.isdigit()), key=int)
    assert int(last) == 25
    for name in (last, f".{last}.crc"):  # the driver was lost before it noted the last batch
        os.remove(f"{offsets}/commits/{name}")
    take_in()
    got = {r.source: [r.accepted, r.skipped] for r in I.read_ledger(spark, f"{out}/ledger").collect()}
    assert got == want
    stored = read_store(spark, f"{out}/events")
    assert {r.source: r["count"] for r in stored.groupBy("source").count().collect()} == {k: v[0] for k, v in want.items()}
    assert len([f for f in os.listdir(f"{out}/ledger") if f.startswith("_batch=")]) <= 12
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_a_sum_that_was_not_finished_is_not_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", 1, 0)], I.LEDGER)
    for number in range(9):
        deltas.write_batch(one, path, number, I._sum_ledger, every=3)
        assert I.read_ledger(spark, path).first().accepted == number + 1
    deltas.write_batch(one, path, 8, I._sum_ledger, every=3)  # repeated, with its sum
    assert I.read_ledger(spark, path).first().accepted == 9
    os.remove(f"{path}/_sums/8/_SUCCESS")
    assert I.read_ledger(spark, path).first().accepted == 9


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    source = tmp_path / "lines"
    for number in range(6):
        write_lines(source, number, ['{"a":1}'] * 100)
    lines = stream_lines(spark, str(source), max_bytes=1700)
    finish(I.ingest(lines, str(tmp_path / "store"), str(tmp_path / "ledger"), str(tmp_path / "offsets"), available_now=True))
    counts = deltas.read_batches(spark, str(tmp_path / "ledger"), I.LEDGER).collect()
    assert [r.accepted for r in counts] == [200, 200, 200] and {r.source for r in counts} == {"default"}
    with pytest.raises(ValueError):
        stream_lines(spark, str(source), 1, 1)


def test_windows_close_with_the_grace_and_not_before(spark, tmp_path):
    """(minutes of the event, minutes of its arrival) batch by batch, and the windows in the sink after each."""
    source = str(tmp_path / "in")
    os.makedirs(source)
    ddl = "timestamp timestamp_ntz, arrived timestamp_ntz, source string"
    steps = [
        ([(5, 5), (50, 50), (55, 52)], {}),
        ([(59, 60.5), (61, 60.9), (90, 60.9)], {}),  # inside the grace: the first hour is open, and an event ahead of its arrival closes nothing
        ([(58, 60.95), (62, 61)], {"202605120000": (5, 0, 0)}),
        ([(3, 70), (300, 80), (None, 81), (70, None)], {"202605120000": (5, 0, 0)}),  # late, future and timeless ones count in the second hour
        ([(400, 400)], {"202605120000": (5, 0, 0), "202605120100": (7, 1, 1)}),
        ([], {"202605120000": (5, 0, 0), "202605120100": (7, 1, 1)}),
    ]
    for batch, want in steps:
        made = [(t, a, "s") for t, a in ([None if m is None else T0 + dt.timedelta(minutes=m) for m in pair] for pair in batch)]
        spark.createDataFrame(made, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        closed = closed_windows(stream, "arrived", "1h")
        I.run_to_parquet(closed, str(tmp_path / "out"), str(tmp_path / "offsets"))
        got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out")).collect()
        assert {r.id: (r.row_count, r.late, r.future) for r in got} == want and len(got) == len(want)
    second = next(r for r in got if r.id == "202605120100")
    assert (second.time_start, second.time_end) == (T0 + dt.timedelta(minutes=3), T0 + dt.timedelta(minutes=300))
    assert second.window_end == T0 + dt.timedelta(hours=2) and second.sources == ["s"]
