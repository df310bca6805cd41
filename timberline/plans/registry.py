"""All registered queries."""

from __future__ import annotations

from timberline.plans import (
    catalog_queries,
    extract_queries,
    facet_queries,
    filters,
    lifecycle_queries,
    searches,
    segment_queries,
    storage_queries,
    stream_queries,
)
from timberline.plans.tables import Case

AREAS = (
    filters,
    searches,
    facet_queries,
    segment_queries,
    lifecycle_queries,
    extract_queries,
    storage_queries,
    stream_queries,
    catalog_queries,
)


def cases() -> list[Case]:
    found = [case for area in AREAS for case in area.CASES]
    names = [case.name for case in found]
    if len(set(names)) < len(names):
        raise ValueError("query names must be distinct")
    return found
