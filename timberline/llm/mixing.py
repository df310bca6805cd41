"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's
target over its source's size. The documents are put in one order (source, size,
id), the expected copies are summed up along it, one random offset per source is
added, and a document is emitted once for every integer its interval crosses. As
the order within a source is by size, each size range is sampled evenly and the
words taken stay near the target.

Sums are integers in units of 2**-24 copies, so they do not depend on the order
of additions, and the offset comes from a hash of the source: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.rows import carried, unpacked
from timberline.llm.words import WORD
from timberline.operators.ordering import with_prefix
from timberline.session import checkpointed

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
UNIT = 1 << 24


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Target of every source from (``source``, ``size``) rows.

    Sources by code point, null last, get the weights in turn and share the sum
    of all sizes; a target above ``most`` times its source's size is cut to that,
    and the rest is shared again by weight until none is above. That ends at
    min(cap, level * weight) for one common level: with the sources in
    order of cap / weight, the level is set by the first that stays below its cap.
    One row per source is all that is ordered here.
    """
    totals = checkpointed(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    numbered = with_prefix(totals, [F.col("source").asc_nulls_last()], number="place")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighted = numbered.withColumn("weight", turn.cast("bigint")).withColumn("cap", most * F.col("source_size"))
    ratio = F.col("cap").cast("double") / F.col("weight")
    ranked = with_prefix(
        weighted,
        [ratio.asc(), F.col("source").asc_nulls_last()],
        number="rank",
        sums={"cap": "caps_before", "weight": "weights_before"},
    )
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left, rest = F.lit(total or 0) - F.col("caps_before"), F.lit(weight or 0) - F.col("weights_before")
    big = "decimal(38,0)"
    below = left.cast(big) * F.col("weight").cast("decimal(9,0)") <= F.col("cap").cast(big) * rest.cast("decimal(18,0)")
    level = ranked.where(below).agg(F.min_by(left.cast("double") / rest, "rank")).first()[0]
    shared = F.lit(level or 0.0).cast("double") * F.col("weight")
    return ranked.select(
        "source", "source_size", "docs", F.least(F.col("cap").cast("double"), shared).alias("target")
    )


def _offset(source: Column, seed: str) -> Column:
    named = F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(seed))
    return F.conv(F.substring(F.md5(named), 1, 6), 16, 10).cast("bigint")


def systematic_copies(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES, seed: str = SEED
) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to rows of
    (``_key``, ``doc_id``, ``source``, ``size``)."""
    targets = checkpointed(source_targets(sizes, weights, most))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = F.least(F.floor(expected * UNIT).cast("bigint"), F.lit(most * UNIT))
    shared = targets.withColumn("units", units).withColumn("source_units", F.col("units") * F.col("docs"))
    shared = with_prefix(shared, [F.col("source").asc_nulls_last()], sums={"source_units": "units_before"})
    # The sources' rows decide how Spark joins them: broadcast only if small, and split where one source is hot.
    rows = sizes.join(shared.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("_key")]
    rows = with_prefix(rows, order, sums={"units": "before"})
    at = F.col("before") - F.col("units_before") + _offset(F.col("source"), seed)
    copies = F.shiftright(at + F.col("units"), 24) - F.shiftright(at, 24)
    return (
        rows.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_key", "doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.xxhash64(F.col(id_col), F.col(source_col), text).alias("_key"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MAX_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """How often each document goes into the mix.

    Returns (``id_col``, ``size``, ``source_size``, ``target``, ``copies``,
    ``taken``), one row per input row; other columns are not read. Size is the
    number of words, 0 for a null text. A null source is a source of its own, the
    last one; a null id comes last in the order. Rows equal in id, source and
    text take neighbouring places, each its own. A source without words has
    target 0 and is not taken. No document is taken more than ``most`` times.
    An empty table gives an empty table.
    """
    plan = systematic_copies(_sized(docs, id_col, source_col, text_col), weights, most, seed)
    return plan.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "copies", "taken")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MAX_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as ``mix_plan`` says.

    Rows equal in id, source and text are one document with the copies of all."""
    plan = systematic_copies(_sized(docs, id_col, source_col, text_col), weights, most, seed)
    totals = plan.groupBy("_key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`").cast("string"))
    rows = carried(docs, key).dropDuplicates(["key"]).join(totals, F.col("key") == F.col("_key"))
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
