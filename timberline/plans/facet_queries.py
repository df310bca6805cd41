"""Facet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators import facets as FC
from timberline.operators.search import matching
from timberline.plans import tables as T
from timberline.plans.tables import Case
from timberline.session import scratch_path
from timberline.sources import store
from timberline.sources.scan import catalog_scan

_K = FC.Facet("k", "attributes.k", 10)
_ALL = (*FC.BUILTIN, _K)
_SEGMENT_SQL = "strftime(time_bucket(INTERVAL '6 hours', timestamp), '%Y%m%d%H%M')"


def _value_sql(field: str) -> str:
    if field.startswith("attributes."):
        return f"json_extract_string(attributes, '$.{field[11:]}')"
    return f"CAST({field} AS VARCHAR)"


def _counts_sql(facets, where: str = "true", view: str = "logs") -> str:
    """CTE text: facet, cap, value, count, rank, total_values."""
    scans = " UNION ALL ".join(
        f"SELECT '{f.name}' AS facet, {f.cap} AS cap, {_value_sql(f.field)} AS value FROM {view} WHERE {where}"
        for f in facets
    )
    return (
        f"pairs AS ({scans}), counted AS (SELECT facet, cap, value, count(*) AS count FROM pairs "
        "WHERE value IS NOT NULL GROUP BY ALL), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY facet "
        "ORDER BY count DESC, value) AS INTEGER) AS rank, count(*) OVER (PARTITION BY facet) AS total_values FROM counted)"
    )


def _report_sql(facets, where: str = "true", view: str = "logs", *ctes: str) -> str:
    return T.with_ctes(
        "SELECT facet, value, count, rank, cap, total_values, total_values > cap AS truncated FROM ranked WHERE rank <= cap",
        *ctes,
        _counts_sql(facets, where, view),
    )


REPORT = ["facet", "value", "count", "rank", "cap", "total_values", "truncated"]


def _report(facets, source=T.logs, schema=T.LOG_SCHEMA, **request):
    def run(spark, sf):
        rows = matching(source(spark, sf), schema, **request)
        return FC.facet_report(rows, facets, schema).select(*REPORT)

    return run


def _one(name: str):
    return FC.select_facets(FC.BUILTIN, [name])


def _table(name: str):
    return lambda spark, sf: T.table(spark, sf, name)


_MESSAGE = [FC.Facet("message", "message", 5), FC.Facet("host", "host", 3)]
_HUGE = [FC.Facet("message", "message", 1500)]
_SHIP = [FC.Facet("flag", "l_returnflag", 2), FC.Facet("status", "l_linestatus", 10)]
_DOCS = [FC.Facet("lang", "lang", 3), FC.Facet("source", "source", 50)]


def _counts(spark, sf):
    return FC.facet_counts(T.logs(spark, sf), _one("host")).select("facet", "value", "count")


def _caps(spark, sf):
    return FC.top_values(FC.facet_counts(T.logs(spark, sf), _ALL), _ALL).groupBy("facet", "cap").agg(
        F.count(F.lit(1)).alias("shown"), F.sum("count").alias("events")
    )


_RANGE = ("2024-01-03T00:00:00Z", "2024-01-25T00:00:00Z")


def _sampled_rows(spark, sf):
    """Rows of the 24 newest segments in range, of a sealed store whose other folders are not read."""
    path = scratch_path(spark, "store")
    store.seal(T.logs(spark, sf), path, T.WIDTH)
    rows = catalog_scan(store.read_store(spark, path), T.segs(spark, sf), *_RANGE, newest=FC.DEFAULT_SAMPLE)
    return matching(rows, start=_RANGE[0], end=_RANGE[1], max_span=None)


def _sampled(spark, sf):
    return FC.facet_report(_sampled_rows(spark, sf), _ALL).select(*REPORT)


def _sample_hits(spark, sf):
    return FC.facet_report(_sampled_rows(spark, sf), _ALL, segment=F.col("segment_id")).select("facet", "value", "count", "sample_segments")


_SAMPLE_CTES = [
    T.LOGS,
    T.SEGS,
    "sample AS (SELECT id FROM segs WHERE state <> 'lost' AND local_path IS NOT NULL AND "
    "time_start <= TIMESTAMP '2024-01-25' AND time_end >= TIMESTAMP '2024-01-03' "
    "ORDER BY time_start DESC, id DESC LIMIT 24)",
    f"sampled AS (SELECT *, {_SEGMENT_SQL} AS segment_id FROM logs WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' "
    f"AND TIMESTAMP '2024-01-25' AND {_SEGMENT_SQL} IN (SELECT id FROM sample))",
]


def _hits_sql() -> str:
    scans = " UNION ALL ".join(
        f"SELECT '{f.name}' AS facet, {f.cap} AS cap, {_value_sql(f.field)} AS value, segment_id FROM sampled"
        for f in _ALL
    )
    return T.with_ctes(
        "SELECT facet, value, count, sample_segments FROM best JOIN hits USING (facet) WHERE rank <= cap",
        *_SAMPLE_CTES,
        f"pairs AS ({scans})",
        "hits AS (SELECT facet, count(DISTINCT segment_id) AS sample_segments FROM pairs WHERE value IS NOT NULL GROUP BY 1)",
        "best AS (SELECT facet, cap, value, count(*) AS count, row_number() OVER (PARTITION BY facet "
        "ORDER BY count(*) DESC, value) AS rank FROM pairs WHERE value IS NOT NULL GROUP BY 1, 2, 3)",
    )


# Definitions: the fixed ones, configured ones from the event types and document
# sources, user ones from the levels, languages and event types.
def _definitions(spark, sf):
    events, docs = T.logs(spark, sf), T.table(spark, sf, "documents")
    kinds = T.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    origins = docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    levels = events.groupBy(F.concat("level", F.lit("_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    langs = docs.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    level = events.groupBy(F.lit("level").alias("name")).agg(F.count(F.lit(1)).alias("n"))

    def shaped(df, origin, cap, value_type):
        return df.select(
            "name",
            F.concat(F.lit("attributes."), F.col("name")).alias("field"),
            F.when(F.length("name") % 2 == 0, F.concat(F.lit("About "), F.col("name"))).otherwise(F.lit(" ")).alias("label"),
            F.lit(cap).cast("int").alias("cap"),
            F.lit(value_type).alias("value_type"),
            F.lit(origin).alias("origin"),
            F.col("n").alias("seq"),
        )

    config = shaped(kinds, "config", 25, "number").unionByName(shaped(origins, "config", 0, "text"))
    user = (
        shaped(levels, "user", None, "bool")
        .unionByName(shaped(langs, "user", 7, None))
        .unionByName(shaped(kinds, "user", 5, "string"))
        .unionByName(shaped(level, "user", 5, "string"))
    )
    return FC.builtin_definitions(spark).unionByName(config).unionByName(user)


_DEFINITIONS = """kinds AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1),
  origins AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1),
  levels AS (SELECT concat(level, '_name') AS name, count(*) AS n FROM logs GROUP BY 1),
  langs AS (SELECT lang AS name, count(*) AS n FROM documents GROUP BY 1),
  custom AS (SELECT name, n, 'config' AS origin, 1 AS priority, 25 AS cap, 'number' AS value_type FROM kinds
    UNION ALL SELECT name, n, 'config', 1, 0, 'text' FROM origins
    UNION ALL SELECT name, n, 'user', 2, NULL, 'bool' FROM levels
    UNION ALL SELECT name, n, 'user', 2, 7, NULL FROM langs
    UNION ALL SELECT name, n, 'user', 2, 5, 'string' FROM kinds
    UNION ALL SELECT 'level', count(*), 'user', 2, 5, 'string' FROM logs),
  builtin AS (SELECT * FROM (VALUES ('service', 'Service', 100, 0), ('level', 'Level', 10, 1), ('host', 'Host', 50, 2),
    ('source', 'Source', 50, 3)) AS b(name, label, cap, n)),
  defs AS (SELECT name, name AS field, label, cap, 'string' AS value_type, 'builtin' AS origin, 0 AS priority, n FROM builtin
    UNION ALL SELECT name, concat('attributes.', name),
      CASE WHEN length(name) % 2 = 0 THEN concat('About ', name) ELSE
        array_to_string(list_transform(list_filter(string_split_regex(name, '[_.-]'), lambda w: w <> ''),
          lambda w: concat(upper(w[1]), w[2:])), ' ') END,
      CASE WHEN cap > 0 THEN cap ELSE 50 END,
      CASE WHEN value_type IN ('string', 'number', 'bool') THEN value_type ELSE 'string' END, origin, priority, n FROM custom),
  placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority, n) AS place,
    first_value(origin) OVER (PARTITION BY name ORDER BY priority, n) AS holder FROM defs)"""


def _registry(spark, sf):
    return FC.merge_definitions(_definitions(spark, sf))[0]


def _conflicts(spark, sf):
    return FC.merge_definitions(_definitions(spark, sf))[1]


def _by_kind(spark, sf):
    return FC.count_by_kind(_registry(spark, sf))


def _suggest(spark, sf):
    rows = matching(T.logs(spark, sf), start="2024-01-05T00:00:00Z", end="2024-01-12T00:00:00Z")
    return FC.suggest_values(rows, "host", "T-", 5)


def _suggest_attr(spark, sf):
    return FC.suggest_values(T.logs(spark, sf), "attributes.k", "1", 20)


def _suggest_sql(value: str, where: str, needle: str, maximum: int) -> str:
    return T.with_ctes(
        f"SELECT value, count FROM (SELECT {value} AS value, count(*) AS count FROM logs WHERE {where} "
        f"AND {value} IS NOT NULL GROUP BY 1) WHERE contains(lower(value), '{needle}') "
        f"ORDER BY count DESC, value LIMIT {maximum}",
        T.LOGS,
    )


CASES = [
    Case("fct_service", _report(_one("service")), _report_sql(_one("service"), "true", "logs", T.LOGS)),
    Case(
        "fct_level",
        _report(_one("level"), where=P.leaf("service", "exists"), text="user 3"),
        _report_sql(
            _one("level"),
            "service IS NOT NULL AND (contains(lower(message), 'user 3') OR contains(lower(raw), 'user 3'))",
            "logs",
            T.LOGS,
        ),
    ),
    Case(
        "fct_host_counts",
        _counts,
        T.with_ctes("SELECT 'host' AS facet, host AS value, count(*) AS count FROM logs GROUP BY ALL", T.LOGS),
    ),
    Case("fct_attr", _report([_K], T.mixed), _report_sql([_K], "true", "mixed", T.LOGS, T.MIXED)),
    Case(
        "fct_all",
        _report(_ALL, where=P.leaf("level", "in", ["error", "warn"])),
        _report_sql(_ALL, "level IN ('error', 'warn')", "logs", T.LOGS),
    ),
    Case("fct_topn", _report(_MESSAGE), _report_sql(_MESSAGE, "true", "logs", T.LOGS)),
    Case("fct_truncated", _report(_HUGE), _report_sql(_HUGE, "true", "logs", T.LOGS)),
    Case(
        "fct_lineitem",
        _report(_SHIP, _table("lineitem"), T.SHIP_SCHEMA, start="1996-01-01", end="1999-12-31", max_span=None),
        _report_sql(_SHIP, "l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'", "lineitem").replace(
            "CAST(l_returnflag AS VARCHAR) AS value", "l_returnflag AS value"
        ),
    ),
    Case(
        "fct_documents",
        _report(_DOCS, _table("documents"), T.DOC_SCHEMA, text="the"),
        _report_sql(_DOCS, "contains(lower(text), 'the')", "documents"),
    ),
    Case(
        "fct_caps",
        _caps,
        T.with_ctes(
            "SELECT facet, cap, count(*) AS shown, CAST(sum(count) AS BIGINT) AS events FROM ranked WHERE rank <= cap "
            "GROUP BY ALL",
            T.LOGS,
            _counts_sql(_ALL),
        ),
    ),
    Case("fct_sampled", _sampled, _report_sql(_ALL, "true", "sampled", *_SAMPLE_CTES)),
    Case("fct_sample_hits", _sample_hits, _hits_sql()),
    Case(
        "fct_registry",
        _registry,
        T.with_ctes(
            "SELECT name, field, label, cap, value_type, CASE WHEN origin = 'builtin' THEN 'builtin' ELSE 'custom' END "
            "AS kind, origin FROM placed WHERE place = 1",
            T.LOGS,
            _DEFINITIONS,
        ),
    ),
    Case(
        "fct_conflicts",
        _conflicts,
        T.with_ctes(
            "SELECT name, origin, field, holder AS hidden_by FROM placed WHERE place > 1", T.LOGS, _DEFINITIONS
        ),
    ),
    Case(
        "fct_by_kind",
        _by_kind,
        T.with_ctes(
            "SELECT CASE WHEN origin = 'builtin' THEN 'builtin' ELSE 'custom' END AS kind, origin, count(*) AS count "
            "FROM placed WHERE place = 1 GROUP BY ALL",
            T.LOGS,
            _DEFINITIONS,
        ),
    ),
    Case(
        "fct_select",
        _report(FC.select_facets(_ALL, ["k", "level"])),
        _report_sql(FC.select_facets(_ALL, ["k", "level"]), "true", "logs", T.LOGS),
    ),
    Case(
        "fct_suggest",
        _suggest,
        _suggest_sql("host", "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'", "t-", 5),
    ),
    Case("fct_suggest_attr", _suggest_attr, _suggest_sql("json_extract_string(attributes, '$.k')", "true", "1", 20)),
]
