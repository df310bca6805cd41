"""Newline-delimited JSON lines as a frame, and per-source ingest accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.extract import extract, is_object_line


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strip one trailing carriage return; drop empty lines (they count nowhere)."""
    text = F.col(column)
    # Two cheap tests; the pattern runs only on lines that end in a return.
    kept = lines.filter((text != "") & (text != "\r"))
    stripped = F.when(F.endswith(text, F.lit("\r")), F.regexp_replace(text, r"\r\z", "")).otherwise(text)
    return kept.withColumn(column, stripped).withColumnRenamed(column, "line")


# Endings of files that hold no plain text and that are not read; gzip is.
REFUSED = (".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate", ".br", ".xz", ".zip", ".z", ".7z", ".lzo")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files; ``.gz`` files are decompressed by Spark (one task each).

    Files of another encoding are refused, by their ending. ``lineSep`` is set
    because the default also splits at a bare ``\\r``.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    if refused := [f for f in lines.inputFiles() if f.lower().endswith(REFUSED)]:
        raise ValueError(f"unsupported encoding: {refused[:3]}")
    return clean_lines(lines)


def stream_lines(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None, folder: str | None = None
) -> DataFrame:
    """Lines of files as they arrive.

    A micro-batch takes at most ``max_files`` files, or files of ``max_bytes`` together (one file at least); of neither, 1000 files.
    With ``folder`` the files lie in folders ``<folder>=<value>``, and the value is added as a column of that name.
    """
    if max_files is not None and max_bytes is not None:
        raise ValueError("bound a batch by files or by bytes, not by both")
    bound = ("maxBytesPerTrigger", max_bytes) if max_bytes is not None else ("maxFilesPerTrigger", max_files or 1000)
    reader = spark.readStream.option("lineSep", "\n").option(*bound)
    if folder is None:
        return clean_lines(reader.text(path))
    lines = reader.option("recursiveFileLookup", "true").text(path)
    value = F.regexp_extract(F.col("_metadata.file_path"), f"/{folder}=([^/]+)/", 1)
    return clean_lines(lines.select("value", value.alias(folder)))


def read_sources(
    spark: SparkSession,
    paths: Mapping[str, str],
    mappings: Mapping[str, Mapping[str, Sequence[str]]],
    ingest_time: Any,
) -> DataFrame:
    """Events of many named sources, each with its own field mapping."""
    unknown = set(paths) - set(mappings)
    if unknown:
        raise ValueError(f"no field mapping for sources {sorted(unknown)}")
    frames = [extract(read_lines(spark, path), mappings[name], name, ingest_time) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, frames)


def accept_skip(lines: DataFrame, source: Column) -> DataFrame:
    """Accepted and skipped lines per source; a bad line never fails the batch."""
    ok = is_object_line(F.col("line"))
    return lines.groupBy(source.alias("source")).agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("skipped")
    )
