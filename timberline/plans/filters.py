"""Filter queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.functions.timeframe import preset_range
from timberline.operators.search import matching
from timberline.plans import tables as T
from timberline.plans.tables import Case

SHOWN = ["event_id", "timestamp", "service", "level", "host"]


def _on(source, node: P.Node | None, schema=T.LOG_SCHEMA, **more: Any):
    def run(spark, sf):
        return matching(source(spark, sf), schema, where=node, **more).select(*SHOWN)

    return run


def _sql(where: str, view: str = "logs") -> str:
    ctes = [T.LOGS] if view == "logs" else [T.LOGS, T.MIXED]
    return T.with_ctes(f"SELECT {', '.join(SHOWN)} FROM {view} WHERE {where}", *ctes)


def _case(name: str, node: P.Node, where: str, source=T.logs, view: str = "logs", schema=T.LOG_SCHEMA) -> Case:
    return Case(name, _on(source, node, schema), _sql(where, view))


_K = "json_extract_string(attributes, '$.k')"
_NUM = f"TRY_CAST({_K} AS DOUBLE)"
_RAW_ATTRS = T.LogSchema(attributes="raw")


def _documents(spark, sf):
    return matching(T.table(spark, sf, "documents"), T.DOC_SCHEMA, text=["the", "license"]).select(
        "doc_id", "lang", "source", "n_chars"
    )


def _phrases(spark, sf):
    return matching(
        T.table(spark, sf, "conversations"), T.CHAT_SCHEMA, where=P.leaf("role", "eq", "USER"), text="  The "
    ).select("conv_id", "turn", "role")


def _customers(spark, sf):
    schema = T.LogSchema(
        timestamp=None, message="c_name", raw=None, attributes=None, source=None, id="c_custkey",
        dims=("c_mktsegment", "n_name"), folded=frozenset(),
    )
    rows = T.table(spark, sf, "customer").join(
        T.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    node = P.all_of(
        P.one_of("c_mktsegment", ["building", "Machinery"]),
        P.none_of(P.wildcard("n_name", "nation_1*")),
    )
    return matching(rows, schema, where=node).select("c_custkey", "c_mktsegment", "n_name")


def _kinds(spark, sf):
    """Event types, which stand in for names a user may get wrong (a handful)."""
    return [r[0] for r in T.table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]


def error_of(check) -> str:
    """The message a refused input raises."""
    try:
        check()
    except ValueError as error:
        return str(error)
    return ""


def _invalid(spark, sf):
    """Trees with an event type where an operator, a list, a group or a value belongs."""
    rows = []
    for kind in _kinds(spark, sf):
        trees = {
            "op": P.all_of({"field": "level", "op": kind, "value": 1}),
            "list": {"field": "level", "op": "in", "value": kind},
            "group": {"op": kind, "children": [P.leaf("level", "eq", kind)]},
            "value": P.any_of(P.leaf("level", "eq", kind), {"field": kind, "op": "eq"}),
            "valid": P.leaf("level", "eq", kind),
        }
        rows += [(kind, name, error_of(lambda tree=tree: P.validate(tree))) for name, tree in trees.items()]
    errors = spark.createDataFrame(rows, "event_type string, tree string, error string")
    counts = T.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return errors.join(counts, "event_type")


_INVALID_SQL = """SELECT event_type, tree, n, CASE tree WHEN 'op' THEN concat('invalid op ''', event_type, '''')
  WHEN 'list' THEN 'op ''in'' needs a non-empty list' WHEN 'group' THEN concat('invalid group op ''', event_type, '''')
  WHEN 'value' THEN 'op ''eq'' needs a value' ELSE '' END AS error
  FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (VALUES ('op'), ('list'), ('group'), ('value'), ('valid')) t(tree)"""


CASES = [
    Case("flt_invalid", _invalid, _INVALID_SQL),
    _case("flt_eq", P.leaf("service", "eq", "WEB"), "lower(service) = 'web'"),
    _case("flt_eq_cs", P.leaf("service", "eq", "Web", case_sensitive=True), "service = 'Web'"),
    _case("flt_neq", P.leaf("service", "neq", "API"), "lower(service) <> 'api'"),
    _case("flt_in", P.one_of("level", ["ERROR", "Warn"]), "level IN ('error', 'warn')"),
    _case("flt_in_null", P.leaf("service", "in", ["web", None]), "lower(service) IN ('web') OR service IS NULL"),
    _case("flt_not_in", P.leaf("service", "not_in", ["web", "api"]), "lower(service) NOT IN ('web', 'api')"),
    _case(
        "flt_not_in_null",
        P.leaf("service", "not_in", ["web", None]),
        "lower(service) NOT IN ('web') AND service IS NOT NULL",
    ),
    _case("flt_contains", P.leaf("message", "contains", "BY USER 1"), "contains(lower(message), 'by user 1')"),
    _case("flt_starts_with", P.leaf("message", "starts_with", "Click By"), "starts_with(lower(message), 'click by')"),
    _case(
        "flt_range_core",
        P.all_of(P.leaf("service", "gte", "api"), P.leaf("timestamp", "lt", "2024-01-15T12:00:00Z")),
        "service >= 'api' AND timestamp < TIMESTAMP '2024-01-15 12:00:00'",
    ),
    _case(
        "flt_range_attr",
        P.all_of(P.leaf("attributes.k", "gt", 50), P.leaf("attributes.k", "lte", "90")),
        f"{_NUM} > 50 AND {_NUM} <= 90",
        T.mixed,
        "mixed",
    ),
    _case("flt_exists_core", P.leaf("service", "exists"), "service IS NOT NULL"),
    _case(
        "flt_exists_attr",
        P.leaf("attributes.k", "exists"),
        "json_extract_string(attributes, '$.k') IS NOT NULL AND json_type(attributes, '$.k') <> 'NULL'",
        T.mixed,
        "mixed",
    ),
    _case(
        "flt_attr_nested",
        P.leaf("attributes.props.k", "eq", 7),
        "json_extract_string(raw, '$.props.k') = '7'",
        schema=_RAW_ATTRS,
    ),
    _case(
        "flt_and_or",
        P.all_of(
            P.any_of(P.leaf("level", "eq", "error"), P.leaf("service", "eq", "worker")),
            P.any_of(P.leaf("host", "in", ["host-1", "HOST-2"]), P.leaf("attributes.k", "lt", 10)),
        ),
        "(level = 'error' OR service = 'worker') AND (host IN ('host-1', 'host-2') OR "
        "CAST(json_extract_string(attributes, '$.k') AS DOUBLE) < 10)",
    ),
    _case("flt_not", P.none_of(P.leaf("service", "eq", "api")), "NOT (lower(service) = 'api')"),
    _case(
        "flt_flat_list",
        [P.leaf("level", "neq", "info"), P.leaf("host", "eq", "host-3"), P.leaf("service", "exists")],
        "level <> 'info' AND host = 'host-3' AND service IS NOT NULL",
    ),
    Case(
        "flt_time_range",
        _on(T.logs, None, start="2024-01-05T00:00:00Z", end="2024-01-07T06:30:00+02:00"),
        _sql("timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 04:30:00'"),
    ),
    Case(
        "flt_time_preset",
        _on(T.logs, None, **dict(zip(("start", "end"), preset_range("24h", "2024-01-20T15:00:00Z")))),
        _sql("timestamp BETWEEN TIMESTAMP '2024-01-19 15:00:00' AND TIMESTAMP '2024-01-20 15:00:00'"),
    ),
    Case(
        "flt_search",
        _on(T.logs, None, text="  User 12 "),
        _sql("contains(lower(message), 'user 12') OR contains(lower(raw), 'user 12')"),
    ),
    Case(
        "flt_search_docs",
        _documents,
        "SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(text), 'the') "
        "AND contains(lower(text), 'license')",
    ),
    Case(
        "flt_search_chat",
        _phrases,
        "SELECT conv_id, turn, role FROM conversations WHERE lower(role) = 'user' AND contains(lower(text), 'the')",
    ),
    Case(
        "flt_customer_list",
        _customers,
        "SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "WHERE lower(c_mktsegment) IN ('building', 'machinery') AND NOT starts_with(lower(n_name), 'nation_1')",
    ),
    _case(
        "flt_wildcard",
        P.any_of(P.wildcard("message", "Sign*"), P.wildcard("host", "*t-6"), P.wildcard("attributes.flag", "*")),
        "starts_with(lower(message), 'sign') OR contains(lower(host), 't-6') OR "
        "coalesce(json_type(attributes, '$.flag'), 'NULL') <> 'NULL'",
        T.mixed,
        "mixed",
    ),
    _case(
        "flt_between",
        P.any_of(P.between("attributes.k", 10, 20), P.between("attributes.k", 80, "*", inclusive=False)),
        f"{_NUM} BETWEEN 10 AND 20 OR {_NUM} > 80",
        T.mixed,
        "mixed",
    ),
    _case(
        "flt_nested_text",
        P.any_of(P.message_has("Purchase"), P.none_of(P.message_has("by user"))),
        "contains(lower(message), 'purchase') OR NOT contains(lower(message), 'by user')",
    ),
    _case(
        "flt_attr_lenient_eq",
        P.any_of(P.leaf("attributes.k", "eq", 42), P.leaf("attributes.flag", "eq", True)),
        f"coalesce({_K} = '42' OR {_NUM} = 42, false) OR coalesce(json_extract_string(attributes, '$.flag') = 'true', false)",
        T.mixed,
        "mixed",
    ),
    _case(
        "flt_literal_kinds",
        P.any_of(*[P.leaf("attributes.k", "eq", P.coerce_literal(token)) for token in ("42", "7.0", "1e1", "n/a")]),
        f"coalesce({_NUM} IN (42, 7, 10), false) OR coalesce({_K} = 'n/a', false)",
        T.mixed,
        "mixed",
    ),
    _case(
        "flt_attr_big_integer",
        P.any_of(P.leaf("attributes.n", "eq", 2**53 + 1), P.leaf("attributes.n", "eq", str(10**27 + 1)), P.leaf("attributes.n", "eq", -7)),
        "event_id % 7 IN (1, 3, 4, 5)",
        T.big,
        "logs",
    ),
    _case(
        "flt_attr_not_in",
        P.leaf("attributes.k", "not_in", [42, "7", "N/A", None]),
        f"lower({_K}) NOT IN ('42', '7', 'n/a') AND coalesce({_NUM}, -1) NOT IN (42, 7) AND {_K} IS NOT NULL",
        T.mixed,
        "mixed",
    ),
]
