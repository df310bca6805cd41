"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import removed, written


ROWS_A_TASK = 200_000  # links
MOST_BROADCAST = 200_000  # nodes with their least neighbour, 16 bytes each


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _sized(links: DataFrame, rows: int) -> DataFrame:
    """In as many tasks as the counted rows need, so that few links are not dealt out as thousands of files."""
    return links.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def _star(links: DataFrame, rows: int, large: bool) -> tuple[DataFrame, str]:
    """Large star: hang the greater neighbours of a node below its least one.
    Small star: the same for the node and its lesser neighbours. Also the path of a table it needs.

    The least neighbours are written before they are joined. Few of them are broadcast, after a count; with
    many, Spark can split a node of very many links, since nothing stands between the shuffle and the join."""
    near = links.union(links.select("b", "a")) if large else links
    near = near.toDF("a", "b")
    found = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    least, path = written(_sized(found, 2 * rows), "least")
    few = least.count() <= MOST_BROADCAST
    pairs = near.join(F.broadcast(least) if few else least, "a")
    if large:
        made = pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return made.where("a <> b").distinct(), path


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links (first two columns), the
    root being the least node that can be reached.

    Null ends and loops are no links. Links are always from greater to lesser
    nodes (a > b), each round is two stars, and the number of
    rounds is about the logarithm of the longest path. Nothing is collected
    but counts and one checksum a round, and each round's tables go with it.
    """
    spark = links.sparkSession
    a, b = (F.col(c) for c in links.columns[:2])
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b))
    now, path = written(now.distinct(), "links")
    before = _state(now)
    while before[0]:
        half, one = _star(now, before[0], True)
        whole, two = _star(half, before[0], False)
        now, new = written(_sized(whole, before[0]), "links")
        removed(spark, path, one, two)
        path = new
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct()
    )


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (``node``, ``root``) after some more links, which join whole components.

    Only the roots of what they join are linked anew, so the work follows the new links."""
    known = roots.select("node", "root")
    ends = [known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
    met = links.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left")
    met, _ = written(met.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "met")
    over, _ = written(components(met).select(F.col("node").alias("_root"), F.col("root").alias("_least")), "over")
    kept = known.join(over, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_least", "root").alias("root"))
    # Nodes without a component so far.
    new = over.join(known, F.col("_root") == F.col("node"), "left_anti").select(F.col("_root").alias("node"), F.col("_least").alias("root"))
    return written(kept.union(new), "roots")[0]
