"""Extraction queries over the raw line table."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.levels import canonical_level
from timberline.plans import tables as T
from timberline.plans.tables import Case
from timberline.sources import extract as X
from timberline.sources import ndjson as N

# SQL restatement of the default mapping: value and path of every field.
_RFC = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$'"


def _path(p: str) -> str:
    return f"""'$."{p}"'"""


def _text(p: str) -> str:
    return f"json_extract_string(j, {_path(p)})"


def _kind(p: str) -> str:
    return f"json_type(j, {_path(p)})"


def _ts_sql(p: str) -> str:
    return (
        f"CASE WHEN {_kind(p)} = 'VARCHAR' AND regexp_matches({_text(p)}, {_RFC}) THEN make_timestamp(epoch_us(TRY_CAST({_text(p)} AS TIMESTAMPTZ))) "
        f"WHEN {_kind(p)} IN ('UBIGINT', 'BIGINT') THEN make_timestamp(CAST({_text(p)} AS BIGINT) * "
        f"CASE WHEN CAST({_text(p)} AS BIGINT) >= 1000000000000 THEN 1000 ELSE 1000000 END) END"
    )


def _token_sql(p: str) -> str:
    return f"CASE WHEN {_kind(p)} IN ('VARCHAR', 'UBIGINT', 'BIGINT') THEN trim({_text(p)}) END"


def _message_sql(p: str) -> str:
    return f"CASE WHEN {_kind(p)} <> 'NULL' THEN {_text(p)} END"


def _name_sql(p: str) -> str:
    return f"CASE WHEN {_kind(p)} = 'VARCHAR' THEN nullif({_text(p)}, '') END"


def _field_sql(name: str, paths, value) -> str:
    picks = ", ".join(value(p) for p in paths)
    places = " ".join(f"WHEN {value(p)} IS NOT NULL THEN '{p}'" for p in paths)
    return f"coalesce({picks}, NULL) AS f_{name}, CASE {places} END AS p_{name}"


_M = X.DEFAULT_MAPPING
_FIELDS = (
    "fields AS (SELECT event_id, line, j, "
    + ", ".join(
        [
            _field_sql("ts", _M["timestamp"], _ts_sql),
            _field_sql("level", _M["level"], _token_sql),
            _field_sql("message", _M["message"], _message_sql),
            _field_sql("service", _M["service"], _name_sql),
            _field_sql("host", _M["host"], _name_sql),
        ]
    )
    + " FROM docs)"
)
# The tokens that occur in the lines.
_KNOWN = (
    "CASE lower(f_level) WHEN 'info' THEN 'info' WHEN 'warning' THEN 'warn' WHEN 'crit' THEN 'error' "
    "WHEN '5' THEN 'error' END"
)
_CTES = [T.NDJSON, T.LINES, T.DOCS, _FIELDS]
_LEVEL = f"coalesce({_KNOWN}, 'info')"


_RESIDUAL = (
    "SELECT event_id, e.key AS key, CAST(e.value AS VARCHAR) AS value FROM fields, json_each(j) e WHERE e.key NOT IN "
    "(coalesce(p_ts, ''), coalesce(p_level, ''), coalesce(p_message, ''), coalesce(p_service, ''), coalesce(p_host, ''))"
)
_MARKERS = (
    "SELECT event_id, 'ingest_timestamp_fallback' AS key, 'true' AS value FROM fields WHERE f_ts IS NULL UNION ALL "
    "SELECT event_id, 'ingest_level_fallback', 'true' FROM fields WHERE f_level IS NULL UNION ALL "
    f"SELECT event_id, 'ingest_level_original', concat('\"', f_level, '\"') FROM fields WHERE {_KNOWN} <> f_level UNION ALL "
    "SELECT event_id, 'ingest_level_unrecognized', concat('\"', f_level, '\"') FROM fields "
    f"WHERE f_level IS NOT NULL AND {_KNOWN} IS NULL"
)
# All entries of an event's attributes as one sorted text, and what gives it for a row of fields.
ATTRS = (
    "attrs AS (SELECT event_id, string_agg(entry, ';' ORDER BY entry) AS attributes FROM (SELECT event_id, "
    f"concat(key, '=', value) AS entry FROM ({_RESIDUAL} UNION ALL {_MARKERS})) GROUP BY 1)"
)
ATTRIBUTES = "coalesce((SELECT a.attributes FROM attrs a WHERE a.event_id = fields.event_id), '')"


def entries_text(attributes):
    """The entries of an attributes text, sorted, as one comparable text."""
    entries = F.map_entries(F.try_parse_json(attributes).try_cast("map<string,variant>"))
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"])))), ";")


def _sql(body: str) -> str:
    return T.with_ctes(body, *_CTES)


def lines(spark, sf):
    return N.clean_lines(T.ndjson(spark, sf))


def _docs(spark, sf):
    return lines(spark, sf).select("event_id", X.parse_line(F.col("line")).alias("_doc")).filter(
        F.col("_doc").isNotNull()
    )


def _resolved(spark, sf):
    return X.resolve_fields(_docs(spark, sf), X.DEFAULT_MAPPING)


def _events(spark, sf):
    rows = X.extract(lines(spark, sf), source="app", ingest_time=T.INGEST_TIME, keep=["event_id"])
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _gate(spark, sf):
    return lines(spark, sf).select("event_id", X.is_object_line(F.col("line")).alias("accepted"))


def _lookup(spark, sf):
    docs = _docs(spark, sf)

    def text(path):
        return F.try_variant_get(X.value_at(F.col("_doc"), path), "$", "string")

    return docs.select(
        "event_id",
        text("user.id").alias("user_id"),
        text("message.a").alias("message_a"),
        text("level.0").alias("level_0"),
        text("@timestamp").alias("at_timestamp"),
    )


def _candidates(spark, sf):
    return _resolved(spark, sf).select(
        "event_id",
        *[F.col(f"_{f}_path").alias(f"{f}_path") for f in ("timestamp", "level", "message", "service", "host")],
    )


def _timestamp(spark, sf):
    return _resolved(spark, sf).select("event_id", F.col("_timestamp").cast("timestamp_ntz").alias("ts"))


def _fallback(spark, sf):
    marker = F.get_json_object("attributes", "$.ingest_timestamp_fallback")
    return _events(spark, sf).select("event_id", "timestamp", marker.alias("marker"))


def _level(spark, sf):
    return _resolved(spark, sf).select(
        "event_id", F.col("_level").alias("token"), canonical_level(F.col("_level")).alias("level")
    )


def _level_marker(name):
    def run(spark, sf):
        marker = F.get_json_object("attributes", f"$.ingest_level_{name}")
        return _events(spark, sf).select("event_id", "level", marker.alias("marker"))

    return run


def _columns(*names):
    return lambda spark, sf: _events(spark, sf).select("event_id", *names)


def _entries(markers: bool):
    def run(spark, sf):
        entries = F.try_parse_json("attributes").try_cast("map<string,variant>")
        pairs = _events(spark, sf).select("event_id", F.explode(entries).alias("key", "value"))
        marked = F.startswith("key", F.lit("ingest_"))
        return pairs.filter(marked if markers else ~marked).select("event_id", "key", F.to_json("value").alias("value"))

    return run


def _full(spark, sf):
    return _events(spark, sf).withColumn("attributes", entries_text("attributes"))


def _counts(spark, sf):
    source = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    return N.accept_skip(lines(spark, sf), source)


def _nested(spark, sf):
    """A mapping with nested paths on the raw lines of the log table."""
    mapping = {
        "timestamp": ["props.none"],
        "level": ["event_type"],
        "message": ["props.k"],
        "service": ["user.name", "event_type"],
        "host": ["props.host"],
    }
    rows = T.logs(spark, sf).select("event_id", F.col("raw").alias("line"), F.col("timestamp").alias("at"))
    at = F.col("at").cast("timestamp")
    out = X.extract(rows, mapping, "nested", at, keep=["event_id"], marker="x_")
    return out.select(
        "event_id",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "service",
        "level",
        "message",
        "host",
        F.get_json_object("attributes", "$.user_id").alias("user_id"),
        F.get_json_object("attributes", "$.props").alias("props"),
        F.get_json_object("attributes", "$.x_level_unrecognized").alias("unrecognized"),
    )


CASES = [
    Case("src_accept_skip", _counts, _sql(
        "SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) FILTER (WHERE event_id IN "
        "(SELECT event_id FROM docs)) AS accepted, count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM docs)) AS "
        "skipped FROM lines GROUP BY 1")),
    Case("ext_object_gate", _gate, _sql(
        "SELECT event_id, event_id IN (SELECT event_id FROM docs) AS accepted FROM lines")),
    Case("ext_path_lookup", _lookup, _sql(
        "SELECT event_id, json_extract_string(j, '$.user.id') AS user_id, json_extract_string(j, '$.message.a') AS message_a, "
        "json_extract_string(j, '$.level[0]') AS level_0, json_extract_string(j, '$.\"@timestamp\"') AS at_timestamp FROM docs")),
    Case("ext_candidates", _candidates, _sql(
        "SELECT event_id, p_ts AS timestamp_path, p_level AS level_path, p_message AS message_path, p_service AS service_path, "
        "p_host AS host_path FROM fields")),
    Case("ext_timestamp", _timestamp, _sql("SELECT event_id, f_ts AS ts FROM fields")),
    Case("ext_ts_fallback", _fallback, _sql(
        "SELECT event_id, coalesce(f_ts, TIMESTAMP '2024-02-01') AS timestamp, CASE WHEN f_ts IS NULL THEN 'true' END AS marker "
        "FROM fields")),
    Case("ext_level_norm", _level, _sql(f"SELECT event_id, f_level AS token, {_KNOWN} AS level FROM fields")),
    Case("ext_level_unknown", _level_marker("unrecognized"), _sql(
        f"SELECT event_id, {_LEVEL} AS level, CASE WHEN f_level IS NOT NULL AND {_KNOWN} IS NULL THEN f_level END AS marker "
        "FROM fields")),
    Case("ext_level_fallback", _level_marker("fallback"), _sql(
        f"SELECT event_id, {_LEVEL} AS level, CASE WHEN f_level IS NULL THEN 'true' END AS marker FROM fields")),
    Case("ext_level_original", _level_marker("original"), _sql(
        f"SELECT event_id, {_LEVEL} AS level, CASE WHEN {_KNOWN} <> f_level THEN f_level END AS marker FROM fields")),
    Case("ext_message", _columns("message"), _sql("SELECT event_id, nullif(f_message, '') AS message FROM fields")),
    Case("ext_service_host", _columns("service", "host"), _sql(
        "SELECT event_id, f_service AS service, f_host AS host FROM fields")),
    Case("ext_residual", _entries(False), _sql(_RESIDUAL)),
    Case("ext_markers", _entries(True), _sql(_MARKERS)),
    Case("ext_nulls", _columns("service", "message", "host", "raw"), _sql(
        "SELECT event_id, f_service AS service, nullif(f_message, '') AS message, f_host AS host, line AS raw FROM fields")),
    Case("ext_full", _full, T.with_ctes(
        f"SELECT event_id, coalesce(f_ts, TIMESTAMP '2024-02-01') AS timestamp, f_service AS service, {_LEVEL} AS level, "
        f"nullif(f_message, '') AS message, f_host AS host, 'app' AS source, {ATTRIBUTES} AS attributes, line AS raw "
        "FROM fields", *_CTES, ATTRS)),
    Case("ext_nested_paths", _nested, T.with_ctes(
        "SELECT event_id, timestamp, json_extract_string(raw, '$.event_type') AS service, CASE json_extract_string(raw, "
        "'$.event_type') WHEN 'error' THEN 'error' ELSE 'info' END AS level, json_extract_string(raw, '$.props.k') AS message, "
        "CAST(NULL AS VARCHAR) AS host, json_extract_string(raw, '$.user_id') AS user_id, '{}' AS props, CASE WHEN "
        "json_extract_string(raw, '$.event_type') <> 'error' THEN json_extract_string(raw, '$.event_type') END AS unrecognized "
        "FROM logs", T.LOGS)),
]
