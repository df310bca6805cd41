"""Filter trees as one boolean ``Column``.

A filter is a plain structure: a leaf ``{"field", "op", "value",
"case_sensitive"}``, a group ``{"op": "and" | "or", "not": bool, "children":
[...]}`` or a list of leaves (their conjunction). Batch and streaming frames
use the same column, so a live subscription and a search always agree.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.attributes import NUMBER, PREFIX, attribute_text, number_of
from timberline.functions.timeframe import parse_time, time_literal
from timberline.schema import LogSchema

MAX_DEPTH = 32
EQUALITY = ("eq", "neq")
MEMBERSHIP = ("in", "not_in")
SUBSTRING = ("contains", "starts_with")
ORDERING = {
    "gt": Column.__gt__,
    "gte": Column.__ge__,
    "lt": Column.__lt__,
    "lte": Column.__le__,
}
LEAF_OPS = (*EQUALITY, *MEMBERSHIP, *SUBSTRING, *ORDERING, "exists")

Node = dict[str, Any] | list[Any]


class FilterTooDeep(ValueError):
    """Groups are nested deeper than ``MAX_DEPTH``."""


# --- writing filters ---------------------------------------------------------


def leaf(field: str, op: str, value: Any = None, case_sensitive: bool = False) -> dict[str, Any]:
    node: dict[str, Any] = {"field": field, "op": op}
    if op != "exists":
        node["value"] = value
    if case_sensitive:
        node["case_sensitive"] = True
    return node


def all_of(*children: Node) -> dict[str, Any]:
    return {"op": "and", "children": list(children)}


def any_of(*children: Node) -> dict[str, Any]:
    return {"op": "or", "children": list(children)}


def none_of(*children: Node) -> dict[str, Any]:
    """NOT (a OR b ...)."""
    return {"op": "or", "not": True, "children": list(children)}


def one_of(field: str, values: Iterable[Any]) -> dict[str, Any]:
    """Value list: one value is an equality, more are a membership."""
    items = list(values)
    return leaf(field, "eq", items[0]) if len(items) == 1 else leaf(field, "in", items)


def wildcard(field: str, pattern: str) -> dict[str, Any]:
    """``*`` alone tests existence, ``abc*`` a prefix, any other wildcard a substring."""
    if pattern == "*":
        return leaf(field, "exists")
    literal = re.sub(r"[*?]", "", pattern)
    if literal == pattern:
        return leaf(field, "eq", coerce_literal(pattern))
    if pattern == literal + "*":
        return leaf(field, "starts_with", literal)
    return leaf(field, "contains", literal)


def between(field: str, low: Any = None, high: Any = None, inclusive: bool = True) -> dict[str, Any]:
    """Range with open ends; ``None`` or ``"*"`` leaves an end open."""
    bounds = []
    if low not in (None, "*"):
        bounds.append(leaf(field, "gte" if inclusive else "gt", low))
    if high not in (None, "*"):
        bounds.append(leaf(field, "lte" if inclusive else "lt", high))
    if not bounds:
        return leaf(field, "exists")
    return bounds[0] if len(bounds) == 1 else all_of(*bounds)


def message_has(term: str, schema: LogSchema = LogSchema()) -> dict[str, Any]:
    """A free-text term used inside a group."""
    return leaf(schema.message, "contains", term)


def coerce_literal(token: str, quoted: bool = False) -> Any:
    """Type of a literal written as text: int, else float, else string."""
    if quoted:
        return token
    if re.fullmatch(r"[+-]?[0-9]+", token) and -(2**63) <= int(token) < 2**63:
        return int(token)
    if re.fullmatch(NUMBER, token):
        return float(token)
    return token


# --- checking ----------------------------------------------------------------


def validate(node: Node, depth: int = 1) -> None:
    """Raise ``ValueError`` unless the tree is well formed."""
    if isinstance(node, list):
        node = all_of(*node)
    if not isinstance(node, dict):
        raise ValueError(f"filter node must be a mapping, got {type(node).__name__}")
    if "children" in node:
        if depth > MAX_DEPTH:
            raise FilterTooDeep(f"groups nested deeper than {MAX_DEPTH}")
        if node.get("op") not in ("and", "or"):
            raise ValueError(f"invalid group op {node.get('op')!r}")
        if not node["children"]:
            raise ValueError("group has no children")
        for child in node["children"]:
            validate(child, depth + 1)
        return
    if not node.get("field"):
        raise ValueError("leaf has no field")
    op, value = node.get("op"), node.get("value")
    if op not in LEAF_OPS:
        raise ValueError(f"invalid op {op!r}")
    if op in MEMBERSHIP:
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"op {op!r} needs a non-empty list")
    elif op != "exists" and value is None:
        raise ValueError(f"op {op!r} needs a value")


# --- compiling ---------------------------------------------------------------


def compile_filter(node: Node | None, schema: LogSchema = LogSchema()) -> Column | None:
    """The filter as a ``Column`` under SQL three-valued logic; ``None`` for no filter."""
    if node is None or node == []:
        return None
    validate(node)
    return _compile(node, schema)


def _compile(node: Node, schema: LogSchema) -> Column:
    if isinstance(node, list):
        node = all_of(*node)
    if "children" in node:
        parts = [_compile(child, schema) for child in node["children"]]
        joined = reduce(or_ if node["op"] == "or" else and_, parts)
        return ~joined if node.get("not") else joined
    field = node["field"]
    if field.startswith(PREFIX):
        if schema.attributes is None:
            raise ValueError(f"table has no attributes column for {field!r}")
        return _attribute_leaf(node, attribute_text(schema.attributes, field[len(PREFIX) :]))
    if field == schema.timestamp and node["op"] not in SUBSTRING:
        return _time_leaf(node, schema)
    if field == schema.timestamp:
        return _text_leaf(node, F.date_format(field, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), False)
    if field not in schema.text_columns:
        raise ValueError(f"unknown field {field!r}")
    return _text_leaf(node, F.col(field), field in schema.folded)


def text_of(value: Any) -> str:
    """Text a literal is compared as: integral floats lose their fraction."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isfinite(value) and value == int(value):
            return str(int(value))
        return format(value, "f") if abs(value) >= 1e16 else repr(value)
    if isinstance(value, (int, str)):
        return str(value)
    raise ValueError(f"unsupported literal {value!r}")


def _text_leaf(node: dict[str, Any], col: Column, folded: bool) -> Column:
    op = node["op"]
    if op == "exists":
        return col.isNotNull()
    if op in ORDERING:
        return ORDERING[op](col, F.lit(text_of(node["value"])))
    exact = bool(node.get("case_sensitive"))
    left = col if exact or folded else F.lower(col)

    def lit(value: Any) -> Column:
        text = text_of(value)
        return F.lit(text if exact else text.lower())

    if op == "eq":
        return left == lit(node["value"])
    if op == "neq":
        return left != lit(node["value"])
    if op == "contains":
        return F.contains(left, lit(node["value"]))
    if op == "starts_with":
        return F.startswith(left, lit(node["value"]))
    return _membership(node, col, lambda values: left.isin([lit(v) for v in values]))


def _membership(node: dict[str, Any], col: Column, test) -> Column:
    """IN / NOT IN; a ``None`` member stands for NULL cells."""
    negated = node["op"] == "not_in"
    values = [v for v in node["value"] if v is not None]
    has_null = len(values) < len(node["value"])
    parts = []
    if values:
        hit = test(values)
        parts.append(~hit if negated else hit)
    if has_null:
        parts.append(col.isNotNull() if negated else col.isNull())
    return reduce(and_ if negated else or_, parts)


def _as_number(value: Any) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str) and re.fullmatch(NUMBER, value):
        return float(value)
    return None


# Sign, leading zeros, digits, and a fraction of zeros.
INTEGER = r"^([+-]?)0*([0-9]+?)(?:\.0*)?$"


def _integer_text(value: Any) -> str | None:
    """Sign and digits of an integer literal in plain form, None for other literals."""
    found = re.fullmatch(INTEGER, text_of(value)) if isinstance(value, (int, str)) else None
    if not found:
        return None
    return ("-" if found[1] == "-" and found[2] != "0" else "") + found[2]


def _attribute_equals(col: Column, value: Any, exact: bool) -> Column:
    """Numeric equality for a number (42, "42" and 42.0 agree), else text equality.

    NULL for a missing value, false for a value that is no number. An integer is
    compared by its digits, so integers of any length stay apart, which doubles
    would not keep; a value in exponent form is compared as a double.
    """
    text = text_of(value)
    number = _as_number(value)
    if number is None:
        return col == F.lit(text) if exact else F.lower(col) == F.lit(text.lower())
    equal = number_of(col) == F.lit(number)
    digits = _integer_text(value)
    if digits is not None:
        plain = F.regexp_extract(col, INTEGER, 2)
        minus = F.when((F.regexp_extract(col, INTEGER, 1) == "-") & (plain != "0"), F.lit("-")).otherwise(F.lit(""))
        equal = F.when(col.rlike(INTEGER), F.concat(minus, plain) == F.lit(digits)).otherwise(equal)
    return F.coalesce(equal, F.when(col.isNotNull(), F.lit(False)))


def _attribute_leaf(node: dict[str, Any], col: Column) -> Column:
    op = node["op"]
    exact = bool(node.get("case_sensitive"))
    if op in ORDERING:
        number = _as_number(node["value"])
        if number is None:
            return ORDERING[op](col, F.lit(text_of(node["value"])))
        return ORDERING[op](number_of(col), F.lit(number))
    if op == "eq":
        return _attribute_equals(col, node["value"], exact)
    if op == "neq":
        return ~_attribute_equals(col, node["value"], exact)
    if op in MEMBERSHIP:
        return _membership(
            node, col, lambda values: reduce(or_, [_attribute_equals(col, v, exact) for v in values])
        )
    return _text_leaf(node, col, False)


def _time_leaf(node: dict[str, Any], schema: LogSchema) -> Column:
    """Typed comparison, so the bound reaches the Parquet reader."""
    op, col = node["op"], F.col(schema.timestamp)

    def lit(value: Any) -> Column:
        return time_literal(parse_time(value), schema.ntz)

    if op == "exists":
        return col.isNotNull()
    if op in ORDERING:
        return ORDERING[op](col, lit(node["value"]))
    if op == "eq":
        return col == lit(node["value"])
    if op == "neq":
        return col != lit(node["value"])
    return _membership(node, col, lambda values: col.isin([lit(v) for v in values]))


# --- free text and time ------------------------------------------------------


def search_text(text: str | Iterable[str] | None, schema: LogSchema = LogSchema()) -> Column | None:
    """Case-insensitive substring of message or raw line.

    A string is one phrase; a list of terms must all occur.
    """
    if text is None:
        return None
    phrases = [text] if isinstance(text, str) else list(text)
    needles = [p.strip().lower() for p in phrases if p.strip()]
    if not needles:
        return None
    per_needle = [
        reduce(or_, [F.contains(F.lower(F.col(c)), F.lit(n)) for c in schema.searched]) for n in needles
    ]
    return reduce(and_, per_needle)


def time_range(
    start: Any,
    end: Any,
    schema: LogSchema = LogSchema(),
    max_span: dt.timedelta | None = None,
) -> Column:
    """Both ends inclusive; ``end`` must be later than ``start`` and the span allowed."""
    low, high = parse_time(start), parse_time(end)
    if high <= low:
        raise ValueError("end of the time range must be after its start")
    if max_span is not None and high - low > max_span:
        raise ValueError(f"time range longer than {max_span}")
    col = F.col(schema.timestamp)
    return (col >= time_literal(low, schema.ntz)) & (col <= time_literal(high, schema.ntz))


def conjunction(*parts: Column | None) -> Column | None:
    """AND of the parts that are present."""
    kept = [p for p in parts if p is not None]
    return reduce(and_, kept) if kept else None
