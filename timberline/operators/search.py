"""Time-ranged search: filter, sort, top-k, paging, counting."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.functions.timeframe import iso_utc, parse_time, time_literal
from timberline.operators.ordering import with_prefix
from timberline.schema import EVENT_COLUMNS, LogSchema

DEFAULT_LIMIT = 100
MAX_SPAN = dt.timedelta(days=7)
COUNT_GUARD = 10_001

SortKeys = Sequence[tuple[str, str]]


def matching(
    df: DataFrame,
    schema: LogSchema = LogSchema(),
    start: Any = None,
    end: Any = None,
    where: P.Node | None = None,
    text: str | Iterable[str] | None = None,
    max_span: dt.timedelta | None = MAX_SPAN,
) -> DataFrame:
    """Rows inside the time range that satisfy the filter and the free text."""
    schema = schema.bind(df)
    if (start is None) != (end is None):
        raise ValueError("give both ends of the time range")
    when = P.time_range(start, end, schema, max_span) if start is not None else None
    cond = P.conjunction(when, P.compile_filter(where, schema), P.search_text(text, schema))
    return df if cond is None else df.filter(cond)


def check_sort(sort: SortKeys | None, schema: LogSchema) -> list[tuple[str, str]]:
    keys = list(sort or [(schema.timestamp, "desc")])
    for name, direction in keys:
        if name not in schema.sortable:
            raise ValueError(f"cannot sort by {name!r}")
        if direction not in ("asc", "desc"):
            raise ValueError(f"invalid sort direction {direction!r}")
    return keys


def _total_keys(keys: SortKeys, schema: LogSchema) -> list[tuple[str, str]]:
    """The sort keys ended by the row id, so that the order is total."""
    return [*keys, (schema.id, keys[-1][1])] if schema.id else list(keys)


def sort_order(sort: SortKeys | None, schema: LogSchema = LogSchema()) -> list[Column]:
    """Sort columns; NULL is the smallest value in both directions."""
    keys = _total_keys(check_sort(sort, schema), schema)
    return [F.col(c).asc_nulls_first() if d == "asc" else F.col(c).desc_nulls_last() for c, d in keys]


def page_limit(limit: int | None) -> int:
    """The caller's limit as it is; ``DEFAULT_LIMIT`` if none is given."""
    if limit is None:
        return DEFAULT_LIMIT
    if limit <= 0:
        raise ValueError("limit must be positive")
    return limit


def _constant(name: str, value: Any, schema: LogSchema) -> Column:
    return time_literal(value, schema.ntz) if name == schema.timestamp else F.lit(value)


def after_cursor(cursor: dict[str, Any], sort: SortKeys | None, schema: LogSchema) -> Column:
    """Rows strictly after ``cursor`` (a mapping of sort keys and id) in sort order."""
    keys = _total_keys(check_sort(sort, schema), schema)
    missing = [name for name, _ in keys if name not in cursor]
    if missing:
        raise ValueError(f"cursor has no value for {missing}")
    branches, equal = [], F.lit(True)
    for name, direction in keys:
        col, value = F.col(name), cursor[name]
        if value is None:
            beyond = col.isNotNull() if direction == "asc" else F.lit(False)
            same = col.isNull()
        else:
            bound = _constant(name, value, schema)
            beyond = col > bound if direction == "asc" else (col < bound) | col.isNull()
            same = F.coalesce(col == bound, F.lit(False))
        branches.append(equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & same
    after = reduce(or_, branches)
    head, direction = keys[0]
    if head == schema.timestamp and cursor[head] is not None:
        # Implied by the branches, and simple enough to reach the Parquet reader.
        bound = _constant(head, cursor[head], schema)
        after = after & (F.col(head) >= bound if direction == "asc" else F.col(head) <= bound)
    return after


def search(
    df: DataFrame,
    schema: LogSchema = LogSchema(),
    start: Any = None,
    end: Any = None,
    where: P.Node | None = None,
    text: str | Iterable[str] | None = None,
    sort: SortKeys | None = None,
    limit: int | None = None,
    cursor: dict[str, Any] | None = None,
    max_span: dt.timedelta | None = MAX_SPAN,
) -> DataFrame:
    """The first ``limit`` matching rows in sort order (per-task top-k, then a merge)."""
    schema = schema.bind(df)
    return _first(df, schema, start, end, where, text, sort, page_limit(limit), cursor, max_span)


def _first(df, schema, start, end, where, text, sort, n, cursor, max_span) -> DataFrame:
    rows = matching(df, schema, start, end, where, text, max_span)
    if cursor is not None:
        rows = rows.filter(after_cursor(cursor, sort, schema))
    return rows.orderBy(*sort_order(sort, schema)).limit(n)


def search_page(
    df: DataFrame,
    schema: LogSchema = LogSchema(),
    start: Any = None,
    end: Any = None,
    where: P.Node | None = None,
    text: str | Iterable[str] | None = None,
    sort: SortKeys | None = None,
    limit: int | None = None,
    cursor: dict[str, Any] | None = None,
    max_span: dt.timedelta | None = MAX_SPAN,
) -> DataFrame:
    """One page plus ``has_more``, found by fetching one row beyond the page."""
    schema = schema.bind(df)
    n = page_limit(limit)
    rows = _first(df, schema, start, end, where, text, sort, n + 1, cursor, max_span)
    # One page and a row: what the caller asked to have in one place.
    place = Window.orderBy(*sort_order(sort, schema))
    whole = Window.partitionBy(F.lit(1))
    return (
        rows.withColumn("_n", F.row_number().over(place))
        .withColumn("has_more", F.count(F.lit(1)).over(whole) > n)
        .filter(F.col("_n") <= n)
        .drop("_n")
    )


def next_cursor(
    page: Sequence[Row], sort: SortKeys | None = None, schema: LogSchema = LogSchema()
) -> dict[str, Any] | None:
    """Cursor for the page after ``page`` (collected rows, in sort order)."""
    if not page or not page[-1]["has_more"]:
        return None
    return {name: page[-1][name] for name, _ in _total_keys(check_sort(sort, schema), schema)}


def paginate(
    df: DataFrame, page_size: int, schema: LogSchema = LogSchema(), sort: SortKeys | None = None
) -> DataFrame:
    """Every row with its ``page`` number (1-based) and its ``row_no``."""
    if not schema.id:
        raise ValueError("paging needs an id column for a total order")
    numbered = with_prefix(df, sort_order(sort, schema), number="row_no")
    return numbered.withColumn("page", F.ceil(F.col("row_no") / F.lit(page_size)).cast("bigint"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_capped(df: DataFrame, guard: int = COUNT_GUARD) -> DataFrame:
    """``count``, ``exact`` and ``lower_bound``: no task reads beyond ``guard`` matches."""
    seen = df.select(F.lit(1).alias("_one")).limit(guard).agg(F.count(F.lit(1)).alias("_n"))
    over = F.col("_n") >= guard
    return seen.select(
        F.when(over, F.lit(guard - 1)).otherwise(F.col("_n")).cast("bigint").alias("count"),
        (~over).alias("exact"),
        F.when(over, F.lit(guard - 1)).cast("bigint").alias("lower_bound"),
    )


def count_newest(
    df: DataFrame,
    day: str,
    schema: LogSchema = LogSchema(),
    start: Any = None,
    end: Any = None,
    where: P.Node | None = None,
    text: str | Iterable[str] | None = None,
    guard: int = COUNT_GUARD,
    max_span: dt.timedelta | None = MAX_SPAN,
) -> tuple[int, bool]:
    """Capped count over a store partitioned by event date (column ``day``): the number of
    matches and whether it is exact.

    Reads from the newest day backwards, each time four times as many days, and stops as
    soon as ``guard`` matches are met; a frequent term touches few files, and nothing but one
    count leaves a task.
    """
    rows = matching(df, schema.bind(df), start, end, where, text, max_span)
    low, newest = parse_time(start).date(), parse_time(end).date()
    seen, days, upto = 0, 4, newest
    while True:
        oldest = max(newest - dt.timedelta(days=days - 1), low)
        part = rows.filter((F.col(day) >= F.lit(oldest)) & (F.col(day) <= F.lit(upto)))
        seen += part.agg(F.count(F.lit(1))).first()[0]
        if seen >= guard:
            return guard - 1, False
        if oldest == low:
            return seen, True
        days, upto = days * 4, oldest - dt.timedelta(days=1)


def shape_events(df: DataFrame, schema: LogSchema = LogSchema()) -> DataFrame:
    """Fixed event columns: RFC 3339 time, NULLs kept, absent attributes as ``{}``."""
    keep = [c for c in EVENT_COLUMNS if c in df.columns and c not in (schema.timestamp, schema.attributes)]
    return df.select(
        *([schema.id] if schema.id else []),
        iso_utc(F.col(schema.timestamp)).alias("timestamp"),
        *keep,
        F.coalesce(F.col(schema.attributes), F.lit("{}")).alias("attributes"),
    )


def search_newest(
    df: DataFrame,
    day: str,
    schema: LogSchema = LogSchema(),
    start: Any = None,
    end: Any = None,
    where: P.Node | None = None,
    text: str | Iterable[str] | None = None,
    limit: int | None = None,
    max_span: dt.timedelta | None = MAX_SPAN,
) -> DataFrame:
    """Newest-first search over a store partitioned by event date (column ``day``).

    Same rows as ``search`` with the default sort, but reads from the newest day
    backwards, doubling the number of days, and stops as soon as the days read
    hold ``limit`` matches: every older day can only hold older events.
    """
    schema = schema.bind(df)
    n = page_limit(limit)
    low, high = parse_time(start), parse_time(end)
    rows = matching(df, schema, start, end, where, text, max_span)
    days, newest = 1, high.date()
    while True:
        oldest = max(newest - dt.timedelta(days=days - 1), low.date())
        recent = rows.filter((F.col(day) >= F.lit(oldest)) & (F.col(day) <= F.lit(newest)))
        if oldest == low.date() or len(recent.select(F.lit(1)).take(n)) >= n:
            return recent.orderBy(*sort_order(None, schema)).limit(n)
        days *= 2
