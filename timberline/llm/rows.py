"""Rows of a table of any columns, carried whole beside a key.

The user's columns travel in one struct, so that no name of theirs can meet one that an operator uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, key: Column) -> DataFrame:
    """(``row``, ``key``) of every row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of ``docs`` again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
