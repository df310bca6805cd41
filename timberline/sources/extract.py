"""Raw JSON line to normalised event, in native expressions only.

A mapping lists, per event field, the paths to try in order::

    {"timestamp": ["timestamp", "ts"], "level": ["level"], "message": ["msg"],
     "service": ["app"], "host": ["meta.hosts.0"]}

Each line is parsed once into a variant; every rule reads that variant. The
same expressions serve batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.levels import DEFAULT_LEVEL, canonical_level, trimmed
from timberline.functions.timeframe import time_literal
from timberline.session import require

Mapping_ = Mapping[str, Sequence[str]]

DEFAULT_MAPPING: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "ts", "time", "@timestamp"),
    "level": ("level", "severity"),
    "message": ("message", "msg"),
    "service": ("service", "app"),
    "host": ("host", "hostname"),
}

# Date, 'T', time with seconds, optional fraction, then 'Z' or an offset.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"

# Epoch numbers from this size on are milliseconds.
MILLIS_FROM = 1_000_000_000_000

DEFAULT_MARKER = "ingest_"
_LARGEST_INDEX = 2**31 - 1  # of an array; a greater number can only be a key


def parse_line(line: Column) -> Column:
    """The line as a variant object; NULL for arrays, scalars, null and garbage.

    The cheap test on the first character also rejects them, because valid JSON
    that starts with a brace is an object.
    """
    return F.when(F.startswith(F.ltrim(line, F.lit(" \t\r\n")), F.lit("{")), F.try_parse_json(line))


def is_object_line(line: Column) -> Column:
    return parse_line(line).isNotNull()


# --- values at a path --------------------------------------------------------


def _variant_paths(path: str) -> list[str]:
    """Variant paths for a dotted path; a numeric segment is an index or a key."""
    paths = ["$"]
    for seg in path.split("."):
        if not seg or "'" in seg and '"' in seg:
            raise ValueError(f"cannot address {path!r}")
        quote = '"' if "'" in seg else "'"
        steps = [f"[{quote}{seg}{quote}]"]
        if seg.isdecimal() and int(seg) <= _LARGEST_INDEX:
            steps.insert(0, f"[{int(seg)}]")
        paths = [p + s for p in paths for s in steps]
    return paths


def value_at(doc: Column, path: str) -> Column:
    """Variant at a dotted path; missing gives NULL."""
    found = [F.try_variant_get(doc, p, "variant") for p in _variant_paths(path)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def kind_of(value: Column) -> Column:
    """Type name of a variant value (``STRING``, ``BIGINT``, ``OBJECT<...>``)."""
    return F.schema_of_variant(value)


# --- coercions (variant value and its kind -> field value, or NULL) ----------


def text_at(value: Column, kind: Column) -> Column:
    """A JSON string's text; NULL for any other kind."""
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def as_timestamp(value: Column, kind: Column) -> Column:
    """RFC 3339 text, or an epoch number in seconds or milliseconds by size."""
    text = F.try_variant_get(value, "$", "string")
    epoch = F.try_variant_get(value, "$", "bigint")
    scale = F.when(epoch >= MILLIS_FROM, F.lit(1_000)).otherwise(F.lit(1_000_000))
    return F.when(
        kind == "STRING", F.when(text.rlike(RFC3339), F.translate(text, ",", ".").try_cast("timestamp"))
    ).when(
        F.left(kind, F.lit(2)).isin("BI", "DE", "DO", "FL"),  # BIGINT, DECIMAL, DOUBLE, FLOAT
        F.timestamp_micros(F.try_multiply(epoch, scale)),
    )


def as_level_token(value: Column, kind: Column) -> Column:
    """Trimmed text of a string or integer level; other kinds give way."""
    return F.when(kind.isin("STRING", "BIGINT"), trimmed(F.try_variant_get(value, "$", "string")))


def as_message(value: Column, kind: Column) -> Column:
    """String as it is, scalars as text, arrays and objects as compact JSON."""
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        kind != "VOID", F.to_json(value)
    )


def as_name(value: Column, kind: Column) -> Column:
    """Non-empty string."""
    return F.nullif(text_at(value, kind), F.lit(""))


COERCIONS: dict[str, Callable[[Column, Column], Column]] = {
    "timestamp": as_timestamp,
    "level": as_level_token,
    "message": as_message,
    "service": as_name,
    "host": as_name,
}


def resolve_fields(docs: DataFrame, mapping: Mapping_, doc: str = "_doc") -> DataFrame:
    """Add ``_<field>`` and ``_<field>_path`` for every mapped field: the first
    candidate that coerces and where it was found.

    The steps are separate projections, so a value used more than once is
    computed once.
    """
    paths = list(dict.fromkeys(p for f in COERCIONS for p in mapping.get(f, ())))
    place = {path: i for i, path in enumerate(paths)}
    kept = docs.columns
    values = docs.select(*kept, *[value_at(F.col(doc), p).alias(f"_v{i}") for p, i in place.items()])
    kinds = values.withColumns({f"_k{i}": kind_of(F.col(f"_v{i}")) for i in place.values()})
    tried = {}
    for field, coerce in COERCIONS.items():
        for path in mapping.get(field, ()):
            i = place[path]
            tried[f"_{field}{i}"] = coerce(F.col(f"_v{i}"), F.col(f"_k{i}"))
    coerced = kinds.select(*kept, *[c.alias(n) for n, c in tried.items()])
    picked = []
    for field in COERCIONS:
        names = [(f"_{field}{place[p]}", p) for p in mapping.get(field, ())]
        nothing = F.lit(None).cast("timestamp" if field == "timestamp" else "string")
        hits = [F.when(F.col(n).isNotNull(), F.lit(p)) for n, p in names]
        picked.append(F.coalesce(*[F.col(n) for n, _ in names], nothing).alias(f"_{field}"))
        picked.append(F.coalesce(*hits, F.lit(None).cast("string")).alias(f"_{field}_path"))
    return coerced.select(*kept, *picked)


# --- residual attributes -----------------------------------------------------


def _object_map(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _without(entries: Column, segments: Sequence[str]) -> Column:
    """Map without the leaf at ``segments``; emptied parents stay."""
    head = segments[0]
    if len(segments) == 1:
        return F.map_filter(entries, lambda k, _: k != F.lit(head))

    def prune(key: Column, value: Column) -> Column:
        inner = F.to_variant_object(_without(_object_map(value), segments[1:]))
        return F.when((key == F.lit(head)) & _object_map(value).isNotNull(), inner).otherwise(value)

    return F.transform_values(entries, prune)


def residual(doc: Column, candidates: Sequence[str], taken: Column) -> Column:
    """Top-level entries of the object, less what the array ``taken`` names.

    ``candidates`` lists every key and path that ``taken`` may hold; other keys
    are kept without a look at the array.
    """
    flat = [c for c in candidates if "." not in c]
    entries = _object_map(doc)
    if flat:
        unused = F.map_filter(entries, lambda k, _: ~k.isin(flat) | ~F.array_contains(taken, k))
        # Naming the array twice keeps Spark from moving its construction into
        # the lambda, where it would run for every key.
        entries = F.when(F.size(taken) > 0, unused).otherwise(entries)
    for path in (c for c in candidates if "." in c):
        pruned = _without(entries, path.split("."))
        entries = F.when(F.array_contains(taken, F.lit(path)), pruned).otherwise(entries)
    return entries


def join_objects(left: Column, right: Column) -> Column:
    """One JSON object text from two that share no key."""
    return (
        F.when(right == "{}", left)
        .when(left == "{}", right)
        .otherwise(F.concat(F.left(left, F.length(left) - 1), F.lit(","), F.substr(right, F.lit(2))))
    )


# --- the extractor -----------------------------------------------------------


def extract(
    lines: DataFrame,
    mapping: Mapping_ = DEFAULT_MAPPING,
    source: str | Column = "default",
    ingest_time: Any = None,
    marker: str = DEFAULT_MARKER,
    keep: Sequence[str] = (),
    line: str = "line",
) -> DataFrame:
    """Events of the lines that hold a JSON object; other lines are skipped.

    ``ingest_time`` (a constant or a column) stands in for a missing timestamp.
    Attributes hold everything the mapping did not use, plus the markers
    ``<marker>timestamp_fallback``, ``<marker>level_fallback``,
    ``<marker>level_original`` and ``<marker>level_unrecognized``.
    """
    if ingest_time is None:
        raise ValueError("ingest_time is required")
    require(lines.sparkSession)
    arrived = ingest_time if isinstance(ingest_time, Column) else time_literal(ingest_time, ntz=False)
    stamp = F.lit(source) if isinstance(source, str) else source
    # A filter on a projected parse would be pushed below it and parse each line
    # twice. It cannot move below the explode of a one-element array.
    docs = lines.select(
        *keep,
        F.col(line).alias("raw"),
        stamp.alias("source"),
        arrived.alias("_arrived"),
        F.explode(F.array(parse_line(F.col(line)))).alias("_doc"),
    ).filter(F.col("_doc").isNotNull())

    found = resolve_fields(docs, mapping)
    token = F.col("_level")
    known = F.col("_known")
    leveled = found.withColumn("_known", canonical_level(token))
    markers = {
        f"{marker}timestamp_fallback": F.when(F.col("_timestamp").isNull(), F.lit(True)),
        f"{marker}level_fallback": F.when(token.isNull(), F.lit(True)),
        f"{marker}level_original": F.when(known != token, token),
        f"{marker}level_unrecognized": F.when(known.isNull() & (token != ""), token),
    }
    # A marker that is set replaces an equal key of the line.
    taken = [F.col(f"_{field}_path") for field in COERCIONS]
    taken += [F.when(value.isNotNull(), F.lit(name)) for name, value in markers.items()]
    staged = leveled.withColumns(
        {"_taken": F.array(*[F.coalesce(t, F.lit("")) for t in taken]), "_marks": F.to_json(F.struct(*[v.alias(n) for n, v in markers.items()]))}
    )
    candidates = list(dict.fromkeys([p for field in mapping.values() for p in field] + list(markers)))
    merged = staged.withColumn("_rest", F.to_json(residual(F.col("_doc"), candidates, F.col("_taken"))))
    return merged.select(
        *keep,
        F.coalesce("_timestamp", "_arrived").alias("timestamp"),
        F.col("_service").alias("service"),
        F.coalesce(known, F.lit(DEFAULT_LEVEL)).alias("level"),
        F.nullif(F.col("_message"), F.lit("")).alias("message"),
        F.col("_host").alias("host"),
        "source",
        join_objects(F.col("_rest"), F.col("_marks")).alias("attributes"),
        "raw",
    )
