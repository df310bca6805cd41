"""Facet counts, caps, sampling, suggestions and facet definitions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.attributes import PREFIX, attribute_text
from timberline.schema import LogSchema

DEFAULT_CAP = 50
DEFAULT_SAMPLE = 24  # newest segments that a sampled report reads


@dataclass(frozen=True)
class Facet:
    name: str
    field: str
    cap: int = DEFAULT_CAP
    label: str | None = None
    value_type: str = "string"

    def __post_init__(self) -> None:
        if self.cap <= 0:
            raise ValueError(f"cap of facet {self.name!r} must be positive")


# The facets that always exist, with their caps.
BUILTIN = (
    Facet("service", "service", 100, "Service"),
    Facet("level", "level", 10, "Level"),
    Facet("host", "host", 50, "Host"),
    Facet("source", "source", 50, "Source"),
)


def facet_value(field: str, schema: LogSchema = LogSchema()) -> Column:
    """A facet's value as text."""
    if field.startswith(PREFIX):
        if schema.attributes is None:
            raise ValueError(f"table has no attributes column for {field!r}")
        return attribute_text(schema.attributes, field[len(PREFIX) :])
    if field not in (*schema.text_columns, schema.timestamp):
        raise ValueError(f"unknown facet field {field!r}")
    return F.col(field).cast("string")


def select_facets(facets: Iterable[Facet], names: Sequence[str] | None) -> list[Facet]:
    """The named facets; none named means all; unknown names are refused."""
    known = {f.name: f for f in facets}
    if not names:
        return list(known.values())
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown facets {unknown}")
    return [known[n] for n in names]


def facet_counts(
    df: DataFrame, facets: Sequence[Facet] = BUILTIN, schema: LogSchema = LogSchema(), segment: Column | None = None
) -> DataFrame:
    """``facet, value, count`` (and ``segment``) for all facets from one scan.

    Each row fans out to one (facet, value) pair per facet; pairs are counted
    inside each task before the shuffle, so a value that fills a third of the
    table still travels as one row per task.
    """
    if not facets:
        raise ValueError("no facets given")
    extra = [] if segment is None else [segment.alias("segment")]
    if len(facets) == 1:
        only = facets[0]
        pairs = df.select(*extra, F.lit(only.name).alias("facet"), facet_value(only.field, schema).alias("value"))
    else:
        entries = [
            F.struct(F.lit(f.name).alias("facet"), facet_value(f.field, schema).alias("value")) for f in facets
        ]
        pairs = df.select(*extra, F.inline(F.array(*entries)))
    by = ["facet", "value", *(["segment"] if extra else [])]
    return pairs.filter(F.col("value").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def _caps(facets: Sequence[Facet]) -> Column:
    caps = {f.name: f.cap for f in facets}
    return F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("facet")]


def top_values(counts: DataFrame, facets: Sequence[Facet] = BUILTIN) -> DataFrame:
    """Best ``cap`` values per facet by count, ties by value; adds ``rank`` and ``cap``.

    Every facet is thinned in value-hash groups first, as many as there are
    shuffle partitions, so no task sees all values of a facet, whatever its cap.
    """
    largest = max(f.cap for f in facets)
    order = [F.col("count").desc(), F.col("value").asc()]
    groups = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy("facet", F.pmod(F.xxhash64("value"), F.lit(groups))).orderBy(*order)
    counts = counts.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= largest).drop("_r")
    place = Window.partitionBy("facet").orderBy(*order)
    return (
        counts.withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= largest)
        .withColumn("cap", _caps(facets))
        .filter(F.col("rank") <= F.col("cap"))
    )


def facet_report(
    df: DataFrame, facets: Sequence[Facet] = BUILTIN, schema: LogSchema = LogSchema(), segment: Column | None = None
) -> DataFrame:
    """Top values with ``truncated``, ``total_values`` and, given a segment column,
    ``sample_segments`` (segments that hold at least one value of the facet).

    The totals per facet are a partial aggregate over the same counts, not a
    window over all values of a facet. They read the ``count`` column too, so
    that both branches need the very same aggregate and Spark runs it, and the
    scan below it, once.
    """
    detail = facet_counts(df, facets, schema, segment)
    some = F.col("count") > 0
    if segment is None:
        counts, hits = detail, None
    else:
        counts = detail.groupBy("facet", "value").agg(F.sum("count").alias("count"))
        hits = detail.groupBy("facet").agg(
            F.countDistinct(F.when(some, F.col("segment"))).alias("sample_segments")
        )
    return report_of(counts, facets, hits)


def report_of(counts: DataFrame, facets: Sequence[Facet] = BUILTIN, hits: DataFrame | None = None) -> DataFrame:
    """The report from the ``facet, value, count`` of all values; ``hits`` has one row per facet to add."""
    totals = counts.groupBy("facet").agg(F.count_if(F.col("count") > 0).alias("total_values"))
    if hits is not None:
        totals = totals.join(F.broadcast(hits), "facet")
    # One row per requested facet: small by construction.
    report = top_values(counts, facets).join(F.broadcast(totals), "facet")
    return report.withColumn("truncated", F.col("total_values") > F.col("cap"))


def suggest_values(
    df: DataFrame, field: str, partial: str = "", maximum: int = 10, schema: LogSchema = LogSchema()
) -> DataFrame:
    """The ``maximum`` most frequent values of a field among those that contain ``partial``.

    One partial aggregate and a per-task top-k.
    """
    if maximum <= 0:
        raise ValueError("maximum must be positive")
    value = facet_value(field, schema)
    rows = df.select(value.alias("value"))
    if partial:
        rows = rows.filter(F.contains(F.lower("value"), F.lit(partial.lower())))
    counts = rows.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("value").asc()).limit(maximum)


# --- facet definitions -------------------------------------------------------

DEFINITION = "name string, field string, label string, cap int, value_type string"

# A definition of an earlier origin hides later ones of its name.
ORIGIN_PRIORITY = {"builtin": 0, "config": 1, "user": 2}


def title_label(name: Column) -> Column:
    words = F.filter(F.split(name, "[_.-]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def merge_definitions(
    definitions: DataFrame, default_cap: int = DEFAULT_CAP, builtin_caps: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Winning definitions and the conflicts they hide.

    ``definitions`` has the ``DEFINITION`` columns, ``origin`` (builtin, config
    or user) and ``seq``, the place inside its origin. The winner of a name is
    an aggregate, so many copies of one name never meet in one task.
    """
    priority = F.lit(len(ORIGIN_PRIORITY))
    for origin, level in ORIGIN_PRIORITY.items():
        priority = F.when(F.col("origin") == origin, F.lit(level)).otherwise(priority)
    ranked = definitions.withColumn("priority", priority)
    fields = ["name", "field", "label", "cap", "value_type", "origin", "seq", "priority"]
    best = ranked.groupBy("name").agg(F.min(F.struct("priority", "seq")).alias("best"))
    placed = ranked.select(*fields).join(best, "name")
    wins = (F.col("priority") == F.col("best.priority")) & (F.col("seq") == F.col("best.seq"))

    cap = F.when(F.col("cap") > 0, F.col("cap")).otherwise(F.lit(default_cap))
    for name, value in (builtin_caps or {}).items():
        if value > 0:
            cap = F.when((F.col("name") == name) & (F.col("origin") == "builtin"), F.lit(value)).otherwise(cap)
    label = F.when(F.trim(F.coalesce("label", F.lit(""))) != "", F.col("label")).otherwise(title_label(F.col("name")))
    kind = F.when(F.col("origin") == "builtin", F.lit("builtin")).otherwise(F.lit("custom"))
    known = F.col("value_type").isin("string", "number", "bool")
    winners = placed.filter(wins).select(
        "name",
        "field",
        label.alias("label"),
        cap.cast("int").alias("cap"),
        F.when(known, F.col("value_type")).otherwise(F.lit("string")).alias("value_type"),
        kind.alias("kind"),
        "origin",
    )
    holder = F.element_at(
        F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in ORIGIN_PRIORITY.items()) for x in pair]),
        F.col("best.priority"),
    )
    conflicts = placed.filter(~wins).select("name", "origin", "field", holder.alias("hidden_by"))
    return winners, conflicts


def builtin_definitions(spark: Any) -> DataFrame:
    rows = [(f.name, f.field, f.label, f.cap, f.value_type, "builtin", i) for i, f in enumerate(BUILTIN)]
    return spark.createDataFrame(rows, DEFINITION + ", origin string, seq bigint")


def count_by_kind(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("kind", "origin").agg(F.count(F.lit(1)).alias("count"))
