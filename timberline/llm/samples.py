"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(labels: DataFrame, id_col: str) -> DataFrame:
    return (
        labels.where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("label").cast("int").alias("label"))
    )


def label_counts(labels: DataFrame, id_col: str = "doc_id") -> dict[int, int]:
    """Documents of either label among all that :func:`labelled_sample` chooses from."""
    found = {r.label: r.n for r in _known(labels, id_col).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in (0, 1)}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(``_id``, ``text``, ``label``) of at most ``per_class`` documents of either label.

    ``labels`` holds (``id_col``, ``label`` 0 or 1); rows with a null are
    ignored, and a document labelled both ways counts as 1. The choice is by a hash
    of the id, so reruns agree. The chosen ids number ``2 * per_class`` at most,
    which is what makes them fit to broadcast.
    """
    known = _known(labels, id_col)
    chosen = reduce(
        DataFrame.union,
        [known.where(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)],
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))
