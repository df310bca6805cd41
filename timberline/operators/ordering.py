"""Row numbers and running sums over a whole table in one total order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timberline.session import checkpointed

RANGE_BYTES = 128 << 20  # input bytes a range should hold

_PART = "_part"
_ROW = "_row"
# monotonically_increasing_id holds the row's place in its partition in the low bits.
_PLACE_BITS = 33


def input_bytes(df: DataFrame) -> int:
    """Bytes that the plan's sources hold by their statistics, 0 where that is not known."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except AttributeError:
        return 0
    known = [s for s in sizes if s < 1 << 60]
    return sum(known)


def _running(sums: dict[str, str]):
    """Add the sums of all earlier rows of the partition, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(sums, 0)
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for column, name in sums.items():
                values = np.nan_to_num(batch.column(column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
                upto = totals[column] + np.cumsum(values, dtype=np.int64)
                columns[name] = pa.array(upto - values, pa.int64())
                totals[column] = int(upto[-1]) if len(upto) else totals[column]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def with_prefix(
    df: DataFrame,
    order: Sequence[Column],
    number: str | None = None,
    sums: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``number`` (1-based row number) and, per ``sums`` item ``column ->
    name``, the sum of ``column`` (integers) over all *earlier* rows.

    A window without partition keys would pull the table into one task. Here
    the rows are range-partitioned on the full order (a tie on the leading keys
    is split by the trailing ones) and sorted inside the ranges, which is the one
    shuffle. Numbers and sums inside a range follow from that order; each
    range is summarised to one row, and the running offsets of those few rows are joined
    back. ``order`` must be total. The ranges are checkpointed because their
    sampled bounds must be the same for the summary and for the rows.

    ``partitions`` defaults to as many ranges as keep ``RANGE_BYTES`` of input in one,
    the shuffle partition setting at least.
    """
    sums = sums or {}
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = partitions or max(least, -(-input_bytes(df) // RANGE_BYTES))
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    ranged = ranged.withColumns({_PART: F.spark_partition_id(), _ROW: place})
    if sums:
        added = [StructField(name, LongType()) for name in sums.values()]
        ranged = ranged.mapInArrow(_running(sums), StructType([*ranged.schema.fields, *added]))
    frozen = checkpointed(ranged)

    heads = frozen.groupBy(_PART).agg(
        F.count(F.lit(1)).alias("_base"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_base_{name}") for c, name in sums.items()],
    )
    # One row per range, so this window and broadcast hold `count` rows at most.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = ["_base", *[f"_base_{name}" for name in sums.values()]]
    offsets = heads.select(_PART, *[F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in bases])

    added = []
    if number:
        added.append((F.col(_ROW) + F.col("_base") + 1).cast("bigint").alias(number))
    for name in sums.values():
        added.append((F.col(name) + F.col(f"_base_{name}")).cast("bigint").alias(name))
    return frozen.join(F.broadcast(offsets), _PART).select(*df.columns, *added)
