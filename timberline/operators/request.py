"""A whole search request: page, cursor, facets and statistics, in two scans at most."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.operators import facets as FC
from timberline.operators import search as S
from timberline.schema import LogSchema
from timberline.session import checkpointed


@dataclass(frozen=True)
class SearchRequest:
    start: Any
    end: Any
    where: P.Node | None = None
    text: str | list[str] | None = None
    sort: Sequence[tuple[str, str]] | None = None
    limit: int | None = None
    cursor: dict[str, Any] | None = None
    facets: Sequence[FC.Facet] = field(default_factory=tuple)
    max_span: dt.timedelta | None = S.MAX_SPAN
    count_guard: int | None = None


@dataclass(frozen=True)
class SearchResult:
    """The parts of an answer. The page is a plan of its own, a top-k that pushes its filters into the
    scan; all else is read from one frozen aggregate over one further scan."""

    page: DataFrame
    count: DataFrame
    facets: DataFrame | None
    stats: DataFrame | None
    sort: Sequence[tuple[str, str]] | None
    schema: LogSchema

    def rows(self) -> tuple[list[Row], dict[str, Any] | None]:
        """The page (at most ``limit`` rows) in order, and the next cursor."""
        rows = self.page.orderBy(*S.sort_order(self.sort, self.schema)).collect()
        return rows, S.next_cursor(rows, self.sort, self.schema)


def _summary(
    df: DataFrame,
    schema: LogSchema,
    hit: Column,
    after: Column,
    facets: Sequence[FC.Facet],
    segment: Column | None,
    sampled: Column,
) -> DataFrame:
    """(``kind``, ``name``, ``value``, ``n``): rows that match, rows behind the cursor, rows of each segment
    scanned, rows of each facet value and of each segment that holds one. Counted in the tasks before the shuffle."""

    def entry(kind: str, when: Column, name: str = "", value: Column | None = None) -> Column:
        made = F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), (F.lit("") if value is None else value).alias("value"))
        return F.when(when, made)

    entries = [entry("match", hit), entry("after", hit & after)]
    if segment is not None:
        entries.append(entry("segment", F.lit(True), value=segment.cast("string")))
    for facet in facets:
        value = FC.facet_value(facet.field, schema)
        counted = hit & sampled & value.isNotNull()
        entries.append(entry("facet", counted, facet.name, value))
        if segment is not None:
            entries.append(entry("held", counted, facet.name, segment.cast("string")))
    listed = df.select(F.inline(F.array_compact(F.array(*entries))))
    return checkpointed(listed.groupBy("kind", "name", "value").agg(F.count(F.lit(1)).alias("n")))


def _number(summary: DataFrame, kind: str) -> DataFrame:
    """One row: the sum of a kind, 0 if there is none."""
    found = F.sum(F.when(F.col("kind") == kind, F.col("n")))
    return summary.agg(F.coalesce(found, F.lit(0)).cast("bigint").alias("count"))


def run(
    df: DataFrame,
    request: SearchRequest,
    schema: LogSchema = LogSchema(),
    segment: Column | None = None,
    catalog: DataFrame | None = None,
    sample: int | None = None,
) -> SearchResult:
    """Answer a request.

    Facets and count ignore the cursor; the count is exact unless ``count_guard`` caps it. ``segment`` (the id of
    a row's segment) adds the statistics (``rows_returned``, ``rows_scanned``, ``segments_read``) and the facets' ``sample_segments``. With
    a ``catalog``, ``df`` is a store (``read_store``) of which only the segments that the catalog names for the
    range are read (``catalog_scan``); the statistics are then those of the scan, segments without a hit included, and ``sample``
    restricts the facets to so many of the newest segments.
    """
    from timberline.sources.scan import SAMPLED, catalog_scan
    from timberline.sources.store import SEGMENT

    schema = schema.bind(df)
    rows, sampled = df, F.lit(True)
    if catalog is not None:
        segment = F.col(SEGMENT) if segment is None else segment
        df = catalog_scan(df, catalog, request.start, request.end)
        rows = df if sample is None else catalog_scan(rows, catalog, request.start, request.end, sample=sample)
        sampled = sampled if sample is None else F.col(SAMPLED)
    elif sample is not None:
        raise ValueError("a sample needs a catalog")
    ask = dict(start=request.start, end=request.end, where=request.where, text=request.text, max_span=request.max_span)
    page = S.search_page(df, schema, sort=request.sort, limit=request.limit, cursor=request.cursor, **ask)

    when = P.time_range(request.start, request.end, schema, request.max_span) if request.start is not None else F.lit(True)
    given = P.conjunction(P.compile_filter(request.where, schema), P.search_text(request.text, schema))
    after = F.lit(True) if request.cursor is None else S.after_cursor(request.cursor, request.sort, schema)
    hit = when if given is None else when & given
    if catalog is None:
        # Nothing counts the rows outside the range, so the bound may reach the files.
        rows = rows.filter(when)
    summary = _summary(rows, schema, F.coalesce(hit, F.lit(False)), F.coalesce(after, F.lit(False)), request.facets, segment, sampled)

    count = _number(summary, "match")
    if request.count_guard is not None:
        over = F.col("count") >= request.count_guard
        capped = F.lit(request.count_guard - 1).cast("bigint")
        count = count.select(
            F.when(over, capped).otherwise(F.col("count")).alias("count"), (~over).alias("exact"), F.when(over, capped).alias("lower_bound")
        )
    facets = stats = None
    if request.facets:
        counts = summary.filter("kind = 'facet'").select(F.col("name").alias("facet"), "value", F.col("n").alias("count"))
        held = None
        if segment is not None:
            held = summary.filter("kind = 'held'").groupBy(F.col("name").alias("facet")).agg(F.count(F.lit(1)).alias("sample_segments"))
        facets = FC.report_of(counts, request.facets, held)
    if segment is not None:
        of = {kind: F.when(F.col("kind") == kind, F.col("n")) for kind in ("after", "segment")}
        zero = F.lit(0).cast("bigint")
        stats = summary.agg(
            F.least(F.coalesce(F.sum(of["after"]), zero), F.lit(S.page_limit(request.limit))).cast("bigint").alias("rows_returned"),
            F.coalesce(F.sum(of["segment"]), zero).alias("rows_scanned"),
            F.count(of["segment"]).alias("segments_read"),
        )
    return SearchResult(page=page, count=count, facets=facets, stats=stats, sort=request.sort, schema=schema)
