"""Column roles of a log table and the normalised event schema."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("attributes", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

EVENT_COLUMNS = tuple(EVENT_SCHEMA.fieldNames())


@dataclass(frozen=True)
class LogSchema:
    """Names the columns that play each role, so operators run on any table.

    ``dims`` are plain text columns that may be filtered, sorted and faceted.
    ``folded`` lists the ones stored in lower case already (``level`` after
    extraction): they are compared without ``lower()``, so the comparison
    reaches the Parquet reader. ``id`` makes every sort total. ``ntz`` tells
    whether the time column is ``timestamp_ntz`` (taken as UTC).
    """

    timestamp: str | None = "timestamp"
    message: str | None = "message"
    raw: str | None = "raw"
    attributes: str | None = "attributes"
    source: str | None = "source"
    id: str | None = "event_id"
    dims: tuple[str, ...] = ("service", "level", "host", "source")
    folded: frozenset[str] = frozenset({"level"})
    ntz: bool = True

    def bind(self, df: DataFrame) -> "LogSchema":
        """Same roles, with ``ntz`` taken from the frame's time column."""
        if self.timestamp is None:
            return self
        kind = df.schema[self.timestamp].dataType
        return replace(self, ntz=isinstance(kind, T.TimestampNTZType))

    @property
    def text_columns(self) -> tuple[str, ...]:
        extra = [c for c in (self.message, self.raw) if c]
        return tuple(dict.fromkeys([*self.dims, *extra]))

    @property
    def sortable(self) -> tuple[str, ...]:
        head = [self.timestamp] if self.timestamp else []
        return tuple(dict.fromkeys([*head, *self.dims]))

    @property
    def searched(self) -> tuple[str, ...]:
        return tuple(c for c in (self.message, self.raw) if c)
