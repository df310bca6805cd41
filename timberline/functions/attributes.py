"""Access to values inside the JSON attributes column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "attributes."

# Decimal number text. Keeps Java's looser forms ("1d", "NaN", "0x1p3") out.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def json_path(segments: list[str]) -> str:
    """Object-key path for ``get_json_object``; every segment is a literal key."""
    out = ["$"]
    for seg in segments:
        if not seg:
            raise ValueError("empty segment in attribute path")
        if "'" not in seg:
            out.append(f"['{seg}']")
        elif "[" not in seg:
            out.append(f".{seg}")
        else:
            raise ValueError(f"attribute key {seg!r} cannot be addressed")
    return "".join(out)


def attribute_text(column: str | Column, path: str) -> Column:
    """Value at a dotted path as text; NULL when the key is missing or JSON null."""
    col = F.col(column) if isinstance(column, str) else column
    return F.get_json_object(col, json_path(path.split(".")))


def number_of(text: Column) -> Column:
    """Number held by a text, or NULL when it is not a decimal number.

    The pattern yields '' for other text, which casts to NULL: the text (often a
    JSON lookup) is evaluated once.
    """
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")
