"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 7): each case runs three times to warm up, then BENCH_RUNS times; the
median counts.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from timberline import LogSchema, build_session  # noqa: E402
from timberline.functions import predicates as P  # noqa: E402
from timberline.operators import facets as FC  # noqa: E402
from timberline.operators import lifecycle as L  # noqa: E402
from timberline.operators import search as S  # noqa: E402
from timberline.operators.segments import overlap_join, window_stats  # noqa: E402
from timberline.plans import tables as T  # noqa: E402
from timberline.session import scratch_path  # noqa: E402
from timberline.sources import store  # noqa: E402
from timberline.sources.extract import extract  # noqa: E402
from timberline.sources.ndjson import read_lines  # noqa: E402
from timberline.streaming import live as V  # noqa: E402
from timberline.plans.stream_queries import subscriptions  # noqa: E402

FULL = dict(start="2024-01-01T00:00:00Z", end="2024-01-31T00:00:00Z", max_span=None)
DAY = dict(start="2024-01-15T00:00:00Z", end="2024-01-16T00:00:00Z")


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def cases(spark, sf):
    logs = T.logs(spark, sf)
    path = scratch_path(spark, "bench-store")
    store.seal(logs, path, "24h")
    stored = store.read_store(spark, path)
    raw = scratch_path(spark, "bench-lines")
    T.ndjson(spark, sf).select("value").repartition(16).write.text(raw)
    catalog = T.segs(spark, sf)
    errors, serious = P.leaf("level", "eq", "error"), P.leaf("level", "in", ["error", "warn"])
    k_range = P.all_of(P.leaf("attributes.k", "gt", 50), P.leaf("attributes.k", "lt", 90))

    def rows(ask):
        return store.prune(stored, ask["start"], ask["end"], "24h")

    def search_with_facets(where, ask):
        S.search(rows(ask), where=where, limit=100, **ask).collect()
        FC.facet_report(S.matching(rows(ask), where=where, **ask)).collect()

    def count():
        S.count_rows(S.matching(rows(FULL), where=errors, **FULL)).collect()

    def seal():
        out = scratch_path(spark, "bench-seal")
        store.seal(logs, out, "24h")
        window_stats(store.read_store(spark, out), "24h").collect()

    def retention():
        policy = L.RetentionPolicy(max_age=dt.timedelta(days=20), max_bytes=1_500_000)
        L.retention_plan(catalog, policy, T.NOW).collect()

    return {
        "bench_core_short": lambda: search_with_facets(errors, DAY),
        "bench_core_long": lambda: search_with_facets(serious, FULL),
        "bench_attr": lambda: S.search(rows(FULL), where=k_range, limit=100, **FULL).collect(),
        "bench_text": lambda: S.search(rows(FULL), text="user 12", limit=100, **FULL).collect(),
        "bench_count": count,
        "bench_count_capped": lambda: S.count_newest(rows(FULL), store.DAY, where=errors, **FULL),
        "bench_suggest": lambda: FC.suggest_values(S.matching(rows(FULL), **FULL), "service", "", 10).collect(),
        "bench_newest": lambda: S.search_newest(rows(FULL), store.DAY, where=errors, limit=100, **FULL).collect(),
        "bench_seal": seal,
        "bench_extract": lambda: noop(extract(read_lines(spark, raw), ingest_time=T.INGEST_TIME)),
        "bench_pages": lambda: noop(S.paginate(logs.select("event_id", "timestamp", "level"), 100)),
        "bench_documents": lambda: FC.facet_report(
            S.matching(T.table(spark, sf, "documents"), T.DOC_SCHEMA, text="the"),
            [FC.Facet("lang", "lang"), FC.Facet("source", "source")],
            T.DOC_SCHEMA,
        ).collect(),
        "bench_lineitem": lambda: FC.facet_report(
            T.table(spark, sf, "lineitem"),
            [FC.Facet("flag", "l_returnflag"), FC.Facet("status", "l_linestatus")],
            T.SHIP_SCHEMA,
        ).collect(),
        "bench_rate_cap": lambda: noop(V.cap_rate(V.fan_out(logs, subscriptions()), 3, 3600)),
        "bench_retention": retention,
        "bench_overlap": lambda: noop(
            overlap_join(window_stats(logs, "1h"), catalog.select("id", "time_start", "time_end"))
        ),
        "bench_stats": lambda: window_stats(logs, "1h", LogSchema(source="service"), "raw")
        .agg(F.sum("row_count"))
        .collect(),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "7"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            # One machine, so its own folder is one that all tasks share.
            "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='bench-')}",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name, run in cases(spark, sf).items():
        for _ in range(3):
            run()
        took = []
        for _ in range(runs):
            begin = time.perf_counter()
            run()
            took.append(time.perf_counter() - begin)
        timings[name] = round(statistics.median(took), 4)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf)
    print(
        json.dumps(
            {
                "metric": "total_median_query_time",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale[1].rstrip(".")) if scale else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
