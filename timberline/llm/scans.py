"""Running values inside the groups of a table, in a total order, with groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timberline.operators.ordering import RANGE_BYTES, input_bytes
from timberline.session import checkpointed

_PART = "_part"
_HEAD = "_head"


def _scan(key: str, place: str, xors: Sequence[str]):
    """Place and running xors inside each run of equal keys, as far as this task sees the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, held = None, 0, np.zeros(len(xors), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = keys[1:] != keys[:-1]
            goes_on = last is not None and keys[0] == last
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            places = np.arange(n) - starts[run_of] + 1
            first_run = run_of == 0
            if goes_on:
                places[first_run] += count
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i, name in enumerate(xors):
                upto = np.bitwise_xor.accumulate(batch.column(name).to_numpy(zero_copy_only=False))
                before = np.concatenate([[0], upto])[starts]
                values = upto ^ before[run_of]
                if goes_on:
                    values[first_run] ^= held[i]
                held[i] = values[-1]
                columns[name] = pa.array(values, pa.int64())
            last, count = keys[-1], int(places[-1])
            columns[place] = pa.array(places.astype(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _carried(heads: list, xors: Sequence[str], place: str) -> list[tuple]:
    """(task, key, place, xors...) that the first run of a task takes over from the tasks before it."""
    out, key, state = [], None, (0,) * (1 + len(xors))
    for row in heads:
        end = tuple(row.end)
        if key is not None and row.first == key:
            out.append((row[_PART], key, *state))
            if end[0] == key:  # the whole task is one run
                state = (end[1] + state[0], *[a ^ b for a, b in zip(end[2:], state[1:])])
                continue
        key, state = end[0], end[1:]
    return out


def grouped_scan(df: DataFrame, key: str, order: Sequence[Column], place: str, xors: Sequence[str] = ()) -> DataFrame:
    """Add ``place``, a row's 1-based place in its group of equal ``key`` (a bigint without nulls), and
    replace the bigint columns ``xors`` by their running xor inside the group, the row's own included.

    The rows are range-partitioned on key and order and sorted there, the one shuffle, so a group of any
    size is spread over tasks. One row per task tells with what its last group ends; from these the
    driver works out what each task's first group takes over.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(least, -(-input_bytes(df) // RANGE_BYTES))
    ranged = df.repartitionByRange(count, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    ranged = ranged.withColumn(_PART, F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, StructField(place, LongType())])
    frozen = checkpointed(ranged.mapInArrow(_scan(key, place, xors), schema))

    end = F.max(F.struct(key, place, *xors))
    heads = frozen.groupBy(_PART).agg(F.min(key).alias("first"), end.alias("end")).orderBy(_PART).collect()
    carried = _carried(heads, xors, place)
    names = ["_place", *[f"_{x}" for x in xors]]
    fields = ", ".join(f"{name} bigint" for name in names)
    taken = spark.createDataFrame(carried, f"{_PART} int, {_HEAD} bigint, {fields}")
    joined = frozen.join(F.broadcast(taken), _PART, "left")
    own = F.col(_HEAD) == F.col(key)
    return joined.select(
        *[
            F.when(own, F.col(x).bitwiseXOR(F.col(f"_{x}"))).otherwise(F.col(x)).alias(x) if x in xors else F.col(x)
            for x in df.columns
        ],
        F.when(own, F.col(place) + F.col("_place")).otherwise(F.col(place)).alias(place),
    )
