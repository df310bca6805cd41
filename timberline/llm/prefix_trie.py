"""The trie of conversation prefixes, its subtrees summed up by an Euler tour.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Nodes are told
by two running xors of 64-bit hashes of (place, role, text), 128 bits in all, and after that by (least member, depth).
Each node gives an arc into its subtree and one out of it. The arcs' order around the tree is a linked list: into the first
child, from a leaf out again, from there into the next sibling or out of the parent. The list is ranked
(:mod:`timberline.llm.list_rank`), and what the arcs carry is summed in the order of their places: a subtree's sum is the difference
between its two arcs.

No step holds a group in a task: conversations and siblings are walked in range-partitioned
order, members are counted before they are shuffled. Only the digest of the members that end at a node is made in
one pass over their ids, since SHA-256 has no other way; it streams over them and keeps none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.list_rank import list_ranks
from timberline.llm.scans import grouped_scan
from timberline.operators.ordering import with_prefix
from timberline.session import checkpointed

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn's role and text, the same for no two turns that differ."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(``conv_id``, ``place``, ``digest``, ``chars``) of every turn, places from 1 by turn.

    A null turn comes first; turns of equal number are ordered by their digest. A null role or text counts as
    empty; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        turn_digest(role, text).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
        # Splits very many rows that are equal in all else.
        F.monotonically_increasing_id().alias("spread"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("spread")]
    return grouped_scan(rows, "conv_id", order, "place").select("conv_id", "place", "digest", "chars")


def prefix_nodes(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and (``conv_id``, ``depth``, key) of where each conversation ends.

    ``turns`` as :func:`numbered_turns` returns them, ``members`` (``conv_id``) all conversations, those without
    turns too.
    """
    hashes = [F.xxhash64(F.lit(salt), "place", "digest") for salt in (11, 47)]
    own = turns.select("conv_id", F.col("place").alias("depth"), "chars", *[h.alias(k) for h, k in zip(hashes, ("own1", "own2"))])
    keyed = own.select("*", F.col("own1").alias("k1"), F.col("own2").alias("k2"))
    running = grouped_scan(keyed, "conv_id", [F.col("depth")], "_at", xors=("k1", "k2"))
    running = running.select(
        "conv_id", "depth", "chars", "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("own1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("own2")).alias("p2"),
    )
    zero = F.lit(0).cast("bigint")
    roots = members.select("conv_id", *[zero.alias(c) for c in ("depth", "chars", "k1", "k2")], *[F.lit(None).cast("bigint").alias(c) for c in ("p1", "p2")])
    rows = running.union(roots)
    nodes = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("end")).select("conv_id", "end.*")
    return checkpointed(nodes), last


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each run of equal keys."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    now, digest, done = None, None, []
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2")]))
        ids = batch.column("conv_id").to_pylist()
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            listed = ",".join(map(str, ids[at:to])).encode()
            if keys[at] == now:
                digest.update(b"," + listed)
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = keys[at], hashlib.sha256(listed)
            at = to
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if now is not None:
        done = [(*now, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ``ends_sha256``) of the nodes at which conversations end."""
    laid = ends.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "conv_id")
    return laid.mapInArrow(_end_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _next_siblings(nodes: DataFrame) -> DataFrame:
    """(``n``, ``sibling``) for every node that has a next sibling.

    Neighbours in the order of (parent, node) are found by their numbers in it, so the children of one node
    lie in as many tasks as they fill."""
    children = nodes.where(F.col("parent").isNotNull()).select("parent", "n")
    numbered = with_prefix(children, [F.col("parent"), F.col("n")], number="at")
    after = numbered.select((F.col("at") - 1).alias("at"), F.col("parent").alias("_parent"), F.col("n").alias("sibling"))
    return numbered.join(after, "at").where(F.col("parent") == F.col("_parent")).select("n", "sibling")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """(``id``, ``next``) of the arcs of a tree: 2n goes into node n, 2n + 1 out of it.

    ``nodes`` has (``n``, ``parent``), unique numbers of 0 or more and null for the root's parent; children are
    visited by number.
    """
    firsts = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("n")).agg(F.min("n").alias("child"))
    known = nodes.select("n", "parent").join(firsts, "n", "left").join(_next_siblings(nodes), "n", "left")
    n = F.col("n")
    into = F.struct((2 * n).alias("id"), F.coalesce(2 * F.col("child"), 2 * n + 1).alias("next"))
    out = F.struct((2 * n + 1).alias("id"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"))
    return known.select(F.explode(F.array(into, out)).alias("arc")).select("arc.*")


def subtree_sums(nodes: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(``n``, sums) of every node's subtree, itself included: per item ``column -> name`` of ``sums``.

    ``nodes`` has (``n``, ``parent``) as :func:`euler_tour` takes them, and the columns, of integers.
    """
    places = list_ranks(euler_tour(nodes))
    carried = nodes.select((2 * F.col("n")).alias("id"), *sums)
    arcs = places.join(carried, "id", "left")
    summed = with_prefix(arcs, [F.col("place")], sums={c: f"_{c}" for c in sums})
    out = F.col("id") % 2 == 1
    return summed.groupBy(F.floor(F.col("id") / 2).alias("n")).agg(
        *[
            (F.max(F.when(out, F.col(f"_{c}"))) - F.max(F.when(~out, F.col(f"_{c}")))).alias(name)
            for c, name in sums.items()
        ]
    )


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns`` has (``conv_id``, ``place`` from 1 without gaps, ``digest``, ``chars``), ``members`` (``conv_id``) every conversation once.
    The root has depth 0, no text and all members; without members there is no node. ``saved_tokens`` sums over the subtree each
    node's (members - 1) times the characters of its last text. ``ends_sha256`` is of the ids of those members that have
    no further turn, in ascending order and joined by commas.
    """
    keyed, ends = prefix_nodes(turns, members)
    digests = end_digests(ends)
    above = keyed.select(
        (F.col("depth") + 1).alias("_depth"), F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("conv_id").alias("parent_conv_id")
    )
    met = (F.col("depth") == F.col("_depth")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2"))
    named = keyed.join(above, met, "left").join(digests, ["depth", "k1", "k2"], "left")
    named = named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "chars", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )
    # A node is its least member's prefix of that length, so the two tell it.
    numbered = checkpointed(with_prefix(named, [F.col("conv_id"), F.col("depth")], number="n"))
    up = numbered.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("n").alias("parent"))
    tree = numbered.join(up, ["parent_conv_id", "depth"], "left")
    children = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("n")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, "n", "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0).cast("bigint")),
            "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.col("chars"),
        }
    )
    tree = checkpointed(tree)
    sums = subtree_sums(tree, {"leaf": "n_leaves", "saved": "saved_tokens"})
    return tree.join(sums, "n").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
