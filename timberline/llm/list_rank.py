"""Places of the members of a linked list that lies scattered over a cluster.

The list is contracted and expanded again. First, blocks of neighbouring ids each shorten the chains
inside them to their heads, in one shuffle. Then members are spliced out in rounds: one goes whose coin shows heads
while its predecessor's shows tails, a quarter of all in each round, so all rounds together are a few
times the first. What is left, at most ``LEAST`` members, is ranked by pointer doubling in one task. Members that went
get their places from those they hung on, round by round in reverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import checkpointed

BLOCK = 1 << 15  # ids that one block spans, which bounds its rows
LEAST = 1 << 16  # members that one task may rank

_SHORT = "id bigint, next bigint, w bigint, top bigint, off bigint"


def chain_heads(before: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every member the head of its chain and the way from there.

    ``before`` has the index of the member before, its own at a head; ``steps`` the way from that one."""
    top, off = before.copy(), np.where(before == np.arange(len(before)), 0, steps)
    while True:
        further = top[top]
        if np.array_equal(further, top):
            return top, off
        off = off + off[top]
        top = further


def _linked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, nexts (-1: none), weights, and where inside the table the next one is."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    nexts = table.column("next").fill_null(-1).to_numpy()[order]
    weights = table.column("w").to_numpy()[order]
    at = np.minimum(np.searchsorted(ids, nexts), len(ids) - 1)
    return ids, nexts, weights, at, ids[at] == nexts


def _shorten(table: pa.Table) -> pa.Table:
    """Heads of the chains inside a block with what follows the chain (``top`` null), the others with their
    head and the way from it."""
    ids, nexts, weights, at, inside = _linked(table)
    n = len(ids)
    before, steps = np.arange(n), np.zeros(n, np.int64)
    before[at[inside]] = np.flatnonzero(inside)
    steps[at[inside]] = weights[inside]
    top, off = chain_heads(before, steps)
    last = np.flatnonzero(~inside)  # of each chain, one
    follows, way = np.full(n, -1), np.zeros(n, np.int64)
    follows[top[last]] = nexts[last]
    way[top[last]] = off[last] + weights[last]
    head = top == np.arange(n)
    return pa.table(
        {
            "id": ids,
            "next": pa.array(follows, pa.int64(), mask=follows < 0),
            "w": way,
            "top": pa.array(ids[top], pa.int64(), mask=head),
            "off": off,
        }
    )


def _rank(table: pa.Table) -> pa.Table:
    """Places of all members of a whole list."""
    ids, _, weights, at, inside = _linked(table)
    before, steps = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    before[at[inside]] = np.flatnonzero(inside)
    steps[at[inside]] = weights[inside]
    return pa.table({"id": ids, "place": chain_heads(before, steps)[1]})


def _splice(links: DataFrame, turn: int) -> DataFrame:
    """One round: the list without the members that went, and these (``top`` not null)."""
    coin = F.xxhash64(F.lit(turn), "id").bitwiseAND(F.lit(1)) == 1
    a = links.where(~coin).select(F.col("id").alias("a"), F.col("next").alias("an"), F.col("w").alias("aw"))
    b = links.where(coin).select(F.col("id").alias("b"), F.col("next").alias("bn"), F.col("w").alias("bw"))
    met = checkpointed(a.join(b, F.col("an") == F.col("b"), "full"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    none = F.lit(None).cast("bigint")
    kept = met.select(
        F.coalesce("a", "b").alias("id"),
        F.when(both | F.col("a").isNull(), F.col("bn")).otherwise(F.col("an")).alias("next"),
        (F.coalesce("aw", F.lit(0)) + F.coalesce("bw", F.lit(0))).alias("w"),
        none.alias("top"),
        F.lit(0).cast("bigint").alias("off"),
    )
    gone = met.where(both).select(F.col("b").alias("id"), F.col("bn").alias("next"), F.col("bw").alias("w"), F.col("a").alias("top"), F.col("aw").alias("off"))
    return kept.union(gone)


def list_ranks(links: DataFrame, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """(``id``, ``place``) of every member of a list, 0 for its first.

    ``links`` has (``id``, ``next``), bigints of 0 or more: ids unique, exactly one ``next`` null, every other
    one an id that no other row names. An empty table gives an empty one.
    """
    start = links.select("id", "next", F.lit(1).cast("bigint").alias("w"))
    blocks = start.withColumn("block", F.floor(F.col("id") / block)).groupBy("block")
    short = checkpointed(blocks.applyInArrow(lambda t: _shorten(t), _SHORT))
    rounds = []
    while True:
        rounds.append(short.where("top IS NOT NULL").select("id", "top", "off"))
        left = short.where("top IS NULL").select("id", "next", "w")
        if left.count() <= least:
            break
        short = _splice(left, len(rounds))
    ranked = left.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: _rank(t), "id bigint, place bigint")
    for gone in reversed(rounds):
        ranked = checkpointed(ranked)
        tops = ranked.select(F.col("id").alias("top"), "place")
        ranked = ranked.union(gone.join(tops, "top").select("id", (F.col("place") + F.col("off")).alias("place")))
    return ranked
