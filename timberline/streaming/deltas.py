"""Additive results of micro-batches: each batch writes its own, readers sum them up.

A batch's folder is named by its number and replaced when the batch is repeated, so a
restart neither loses nor doubles anything, and a late row counts like any other. Every ``FOLD`` batches the sum so far is
written as one table, and what an earlier sum already holds is removed, so readers open ``2 * FOLD`` folders at most however long a
stream runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from timberline.session import hadoop_path

BATCH = "_batch"
TRIGGER = "1 second"
FOLD = 100
_SUMS = "_sums"


def write_batch(
    df: DataFrame, path: str, number: int, fold: Callable[[DataFrame], DataFrame] | None = None, every: int | None = None
) -> None:
    """Write what batch ``number`` adds; with ``fold``, which sums up rows into rows of the same columns, keep the sum of all."""
    spark, every = df.sparkSession, every or FOLD
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{BATCH}={number}")
    if fold is None or (number + 1) % every:
        return
    # A repeated batch sums up the same folders again: only what the sum before this one holds is removed.
    total = fold(read_batches(spark, path, df.schema, upto=number).drop(BATCH))
    total.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{_SUMS}/{number}")
    for old in [*range(number - 2 * every + 1, number - every + 1), f"{_SUMS}/{number - 2 * every}"]:
        files, folder = hadoop_path(spark, f"{path}/{old}" if isinstance(old, str) else f"{path}/{BATCH}={old}")
        if files.exists(folder):
            files.delete(folder, True)


def _last_sum(spark: SparkSession, path: str, below: int | None) -> int:
    """The last batch that a whole sum holds, -1 if there is none; of those before ``below``."""
    files, folder = hadoop_path(spark, f"{path}/{_SUMS}")
    if not files.exists(folder):
        return -1
    whole = [int(s.getPath().getName()) for s in files.listStatus(folder) if files.exists(hadoop_path(spark, f"{s.getPath()}/_SUCCESS")[1])]
    return max([n for n in whole if below is None or n < below], default=-1)


def read_batches(spark: SparkSession, path: str, schema: str | StructType, upto: int | None = None) -> DataFrame:
    """All that was written so far, sums and single batches, with the batches' number (null in a sum)."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*fields.fields, StructField(BATCH, LongType())])
    summed = _last_sum(spark, path, upto)
    rows = spark.read.schema(whole).option("basePath", path).parquet(path).filter(F.col(BATCH) > summed)
    if upto is not None:
        rows = rows.filter(F.col(BATCH) <= upto)
    if summed < 0:
        return rows
    return rows.unionByName(spark.read.schema(fields).parquet(f"{path}/{_SUMS}/{summed}"), allowMissingColumns=True)


def each_batch(
    stream: DataFrame,
    work: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
    trigger: str = TRIGGER,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait for a query that reads what is available; stop it and raise if it takes longer."""
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} s")
