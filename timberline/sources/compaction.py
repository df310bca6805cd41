"""Merging the small files of a hot store, beside a running writer and under readers.

A stream leaves a folder per segment and micro-batch. A compaction writes the rows of many of them again into one folder, numbered
below zero, and then commits one small file beside the store that says: of this segment, folder -k holds all batches up to n. Readers
(``read_store``, ``seal_closed``) follow the commits: of a segment they read the folder of its last commit and the batches
after it. So a row is seen once before, during and after a compaction, and one that is killed has done nothing: its folder is
in no commit. ``vacuum`` removes what commits have replaced, when no reader from before them is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import checkpointed, hadoop_path
from timberline.sources import store
from timberline.sources.store import BATCH, DAY, ORIGIN, SEGMENT

LEAST_FOLDERS = 4


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}-commits"


def read_commits(spark: SparkSession, path: str) -> DataFrame | None:
    """Per segment its last commit, ``number`` and the last batch ``upto`` that it holds; None before the first one."""
    files, folder = hadoop_path(spark, _commits(path))
    if not files.exists(folder):
        return None
    rows = spark.read.schema("segment_id string, upto bigint, number bigint").json(_commits(path))
    last = rows.groupBy(F.col(SEGMENT).alias("_committed")).agg(F.max(F.struct("number", "upto")).alias("_commit"))
    return last.select("_committed", F.col("_commit.number").alias("_number"), F.col("_commit.upto").alias("_upto"))


def visible(folders: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The rows of a hot store (or of a list of its folders) that its commits let a reader see."""
    commits = read_commits(spark, path)
    if commits is None:
        return folders.filter(F.col(BATCH) >= 0)
    joined = folders.join(commits, F.col(SEGMENT) == F.col("_committed"), "left")
    seen = ((F.col(BATCH) >= 0) & (F.col(BATCH) > F.coalesce("_upto", F.lit(-1)))) | (F.col(BATCH) == -F.col("_number"))
    return joined.filter(seen).select(*folders.columns)


def compact(spark: SparkSession, path: str, least_folders: int = LEAST_FOLDERS, upto: int | None = None) -> DataFrame:
    """Merge the folders of every segment that has ``least_folders`` or more, and return the commit (``segment_id, upto, number``).

    Only batches before the store's last one are merged (up to ``upto`` if given), since that may still be being written. One
    shuffle brings a segment's rows together; Spark splits a segment that is much larger than the rest over many files. A row keeps the
    number of its batch in a column (``ORIGIN``). One compaction of a store may run at a time, beside any writer and readers.
    """
    every = store.raw_folders(spark, path)
    folders = checkpointed(every.select(SEGMENT, BATCH).distinct())
    seen = visible(folders, spark, path)
    if upto is None:
        upto = folders.agg(F.max(BATCH)).first()[0] - 1
    held = seen.filter(F.col(BATCH) <= upto)
    many = held.groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_folders).select(SEGMENT)
    merged = checkpointed(held.join(many, SEGMENT).select(F.col(SEGMENT).alias("_segment"), F.col(BATCH).alias("_number")))
    if merged.isEmpty():
        return merged.select(F.col("_segment").alias(SEGMENT), F.lit(upto).alias("upto"), F.lit(0).alias("number"))
    used = folders.agg(F.max(-F.col(BATCH))).first()[0]
    known = read_commits(spark, path)
    last = known.agg(F.max("_number")).first()[0] if known is not None else 0
    number = max(used, last or 0, 0) + 1

    here = (F.col(SEGMENT) == F.col("_segment")) & (F.col(BATCH) == F.col("_number"))
    rows = every.join(merged, here, "left_semi").withColumns({ORIGIN: F.coalesce(ORIGIN, BATCH), BATCH: F.lit(-number)})
    (
        rows.hint("rebalance", F.col(DAY), F.col(SEGMENT))
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy(DAY, SEGMENT, BATCH)
        .parquet(path)
    )
    commit = merged.select(F.col("_segment").alias(SEGMENT)).distinct()
    commit = commit.select(SEGMENT, F.lit(upto).cast("bigint").alias("upto"), F.lit(number).cast("bigint").alias("number"))
    # One file, so that all of the commit is there or none.
    commit.coalesce(1).write.mode("append").json(_commits(path))
    return commit


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the folders that commits have replaced, and those of compactions that were killed before a later one. Returns their number.

    What is removed follows from the commits alone, so a batch that arrives meanwhile stays. Readers that began
    before the last commit may still need these folders: run it when they have ended.
    """
    commits = read_commits(spark, path)
    if commits is None:
        return 0
    last = commits.agg(F.max("_number")).first()[0]
    folders = checkpointed(store.raw_folders(spark, path).select(SEGMENT, BATCH).distinct())
    joined = folders.join(commits, F.col(SEGMENT) == F.col("_committed"), "left")
    replaced = (F.col(BATCH) >= 0) & (F.col(BATCH) <= F.col("_upto"))
    older = (F.col(BATCH) < 0) & (-F.col(BATCH) < last) & ~F.coalesce(F.col(BATCH) == -F.col("_number"), F.lit(False))
    return remove_folders(joined.filter(replaced | older).select(SEGMENT, BATCH), path)


def folder_of(path: str) -> Column:
    """Name of the folder of a row's segment, or of its batch in that segment."""
    day = F.concat_ws("-", *[F.substring(SEGMENT, at, n) for at, n in ((1, 4), (5, 2), (7, 2))])
    batch = F.coalesce(F.concat(F.lit(f"/{BATCH}="), F.col(BATCH).cast("string")), F.lit(""))
    return F.concat(F.lit(f"{path.rstrip('/')}/{DAY}="), day, F.lit(f"/{SEGMENT}="), F.col(SEGMENT), batch)


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for folder in batch["folder"]:
            system, name = store.open_uri(folder)
            if system.get_file_info(name).type == fs.FileType.Directory:
                system.delete_dir(name)
        yield batch


def remove_folders(folders: DataFrame, path: str) -> int:
    """Remove folders (``segment_id``, ``_batch``, null for the whole segment) of a store, in tasks."""
    tasks = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = folders.select(folder_of(path).alias("folder")).distinct().repartition(tasks, "folder")
    return checkpointed(named.mapInPandas(_remove, "folder string")).count()
