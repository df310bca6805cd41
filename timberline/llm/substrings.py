"""Substring dedup by prefix-partitioned suffix trees over words.

Every run of ``window`` words that starts at two places of the corpus or more
is a repeat; all words it covers are removed. In terms of a suffix tree over
the words: a suffix repeats when its leaf hangs below an internal node of
depth ``window`` or more, and what such nodes cover are the maximal repeats.

The tree is never built whole. Suffixes are split by a prefix of variable
length: the prefix of a suffix ends with the seed (``seed`` words) of least hash
among the seeds inside its first ``window`` words. Equal suffix heads have equal
prefixes, and neighbouring suffixes mostly share the seed, so that one slice of
words stands for a whole run of suffixes.

1. Count the suffixes of every seed. A seed met once cannot lead to a repeat.
2. Slices of the remaining suffixes are shuffled by seed. Each task builds the
   subtrees of its seeds level by level: nodes of depth 1, 2, 4, ... are named
   by the pair of names of their halves, which is exact. A node of depth
   ``window`` with two leaves or more marks those leaves.
3. A seed with more than ``group_suffixes`` suffixes would not fit a task. Its
   prefixes are extended to all ``window`` words, where a group is one node and
   its leaves need only be counted, before the shuffle already. Up to ``hot_seeds``
   such seeds, 8 bytes each, are sent to all tasks, which find them in the texts
   where these lie; if there are more, the runs are joined to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.words import Words, hashed_words, pieces, run_hashes, signed
from timberline.session import checkpointed

WINDOW = 35
SEED = 8
GROUP_SUFFIXES = 20_000
HOT_SEEDS = 1_000_000  # hot seeds that are sent to all tasks; beyond, their runs are joined to the texts
_SLICE = 4096  # suffixes in one slice


def _seed_runs(hashes: np.ndarray, first: np.ndarray, window: int, seed: int):
    """Runs of suffixes with the same seed hash: (text, start, suffixes, seeds, hash)."""
    width = window - seed + 1
    grams = run_hashes(hashes, seed)
    m = len(grams) - width + 1
    empty = np.empty(0, np.int64)
    if m <= 0:
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    least, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, width):
        other = grams[j : j + m]
        smaller = other < least
        least[smaller] = other[smaller]
        at[smaller] = j
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)[:m]
    valid = np.flatnonzero(np.arange(m) + window <= first[text + 1])
    if not len(valid):
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    text, seeds, key = text[valid], valid + at[valid], least[valid]
    new_run = np.ones(len(valid), bool)
    new_run[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    new_seed = np.ones(len(valid), bool)
    new_seed[1:] = seeds[1:] != seeds[:-1]
    heads = np.flatnonzero(new_run)
    return (
        text[heads],
        valid[heads] - first[text[heads]],
        np.diff(np.append(heads, len(valid))),
        np.add.reduceat(new_seed.astype(np.int64), heads),
        key[heads],
    )


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = hashed_words(piece.column("text"))
            text, start, n, seeds, key = _seed_runs(words.hashes, words.first, window, seed)
            keys = piece.column("_key").to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                {
                    "seed": pa.array(signed(key)),
                    "_key": pa.array(keys[text], pa.int64()),
                    "start": pa.array(start, pa.int32()),
                    "n": pa.array(n, pa.int32()),
                    "seeds": pa.array(seeds, pa.int32()),
                }
            )

    return run


def _flat_runs(piece: pa.RecordBatch):
    """Row, start, length and seed of all runs listed in column ``runs``."""
    runs = piece.column("runs")
    row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
    fields = runs.flatten()
    start, n, seed = (fields.field(name).to_numpy(zero_copy_only=False) for name in ("start", "n", "seed"))
    return row, start.astype(np.int64), n.astype(np.int64), seed


def _slices(window: int):
    """The words of every listed run, cut into slices of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = hashed_words(piece.column("text"))
            row, start, n, seed = _flat_runs(piece)
            parts = -(-n // _SLICE)
            at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            row, seed = np.repeat(row, parts), np.repeat(seed, parts)
            start, n = np.repeat(start, parts) + at * _SLICE, np.minimum(np.repeat(n, parts) - at * _SLICE, _SLICE)
            begin, length = words.first[row] + start, n + window - 1
            ends = np.cumsum(length)
            index = np.arange(length.sum()) + np.repeat(begin - (ends - length), length)
            keys = piece.column("_key").to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                {
                    "seed": pa.array(seed, pa.int64()),
                    "_key": pa.array(keys[row], pa.int64()),
                    "start": pa.array(start, pa.int32()),
                    "words": pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends), pa.int32()), pa.array(signed(words.hashes[index]))
                    ),
                }
            )

    return run


def _names(*parts: np.ndarray) -> np.ndarray:
    """One number per distinct tuple."""
    name = np.unique(parts[0], return_inverse=True)[1].astype(np.int64)
    for part in parts[1:]:
        name = np.unique(name * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1].astype(np.int64)
    return name


def _deep_leaves(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each start, whether its node of depth ``window`` has two leaves or more."""
    names, depth = _names(words), 1
    while depth * 2 <= window:
        names = _names(names[:-depth], names[depth:])
        depth *= 2
    if depth < window:
        names = _names(names[starts], names[starts + window - depth])
    else:
        names = names[starts]
    return np.bincount(names)[names] > 1


def _marked(table: pa.Table, window: int) -> pa.RecordBatch:
    """Ranges of repeated suffixes in the slices of whole seeds."""
    slices = table.column("words").combine_chunks()
    length = np.diff(slices.offsets.to_numpy())
    words = slices.flatten().to_numpy()
    n = length - window + 1
    base = np.repeat(np.cumsum(length) - length, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    deep = _deep_leaves(words, base + at, window)
    row = np.repeat(np.arange(len(n)), n)
    return _ranges(
        row[deep],
        (table.column("start").to_numpy().astype(np.int64)[row] + at)[deep],
        table.column("_key").to_numpy(),
    )


def _ranges(row: np.ndarray, start: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring starts within a row as (first, last)."""
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(row)) - 1 if len(heads) else heads
    return pa.record_batch(
        {
            "_key": pa.array(keys[row[heads]], pa.int64()),
            "first": pa.array(start[heads], pa.int32()),
            "last": pa.array(start[tails], pa.int32()),
        }
    )


def _subtrees(window: int):
    """Batches sorted by seed; the last seed of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seed = batch.column("seed").to_numpy()
            cut = int(np.searchsorted(seed, seed[-1], side="left"))
            if cut or (held and held[-1].column("seed")[-1].as_py() != seed[0]):
                yield _marked(pa.Table.from_batches([*held, batch.slice(0, cut)]), window)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _marked(pa.Table.from_batches(held), window)

    return run


def _heads(piece: pa.RecordBatch, words: Words, row: np.ndarray, start: np.ndarray, n: np.ndarray, window: int):
    """The suffixes of the given runs, each with a 128-bit hash of its first ``window`` words."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, start = np.repeat(row, n), np.repeat(start, n) + at
    where = words.first[row] + start
    keys = piece.column("_key").to_numpy(zero_copy_only=False)
    return pa.record_batch(
        {
            "p1": pa.array(signed(run_hashes(words.hashes, window)[where])),
            "p2": pa.array(signed(run_hashes(words.hashes, window, "other")[where])),
            "_key": pa.array(keys[row], pa.int64()),
            "start": pa.array(start, pa.int32()),
        }
    )


def _whole_prefixes(window: int):
    """The suffixes of listed runs; see :func:`_heads`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            row, start, n, _ = _flat_runs(piece)
            yield _heads(piece, hashed_words(piece.column("text")), row, start, n, window)

    return run


def _prefixes_of(seeds: np.ndarray, window: int, seed: int):
    """The suffixes of all runs of the given sorted seeds; see :func:`_heads`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = hashed_words(piece.column("text"))
            row, start, n, _, key = _seed_runs(words.hashes, words.first, window, seed)
            at = np.minimum(np.searchsorted(seeds, key), len(seeds) - 1)
            found = seeds[at] == key
            yield _heads(piece, words, row[found], start[found], n[found], window)

    return run


def _cut(window: int):
    """The kept words of every text, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = piece.column("text")
            marks = piece.column("marks")
            kept, total, removed = [], [], []
            for i in range(piece.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                total.append(len(words))
                ranges = marks[i].as_py()
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["first"] for r in ranges], 1)
                    np.add.at(edge, [r["last"] + window for r in ranges], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            others = [n for n in piece.schema.names if n not in ("text", "marks")]
            yield pa.record_batch(
                {
                    **{n: piece.column(n) for n in others},
                    "text": pa.array(kept, pa.string()),
                    "n_words": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                }
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    seed: int = SEED,
    group_suffixes: int = GROUP_SUFFIXES,
    hot_seeds: int = HOT_SEEDS,
) -> DataFrame:
    """Remove all words covered by a run of ``window`` words that starts at two
    places or more, in one document or several. Judged on the input.

    Returns (``id_col``, ``text``, ``n_words``, ``n_removed``), one row per input
    row; other columns are not read, so their names may clash with anything.

    A null text has no words and comes back empty. A text shorter than
    ``window`` keeps all words. Rows that repeat, null ids included, are
    documents of their own, so a repeated row of ``window`` words or more loses
    all of them in every copy. An empty table gives an empty table.
    """
    if not 0 < seed < window:
        raise ValueError("seed must be shorter than window")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # Equal rows share the key, so marks found for one hold for the other.
    rows = rows.select(F.xxhash64("_id", "text").alias("_key"), "_id", "text")

    runs = rows.select("_key", "text").mapInArrow(
        _seeds(window, seed), "seed bigint, _key bigint, start int, n int, seeds int"
    )
    # Counts are frozen before they are joined: both sides of the join are then plain shuffles, which
    # Spark splits where a seed or a prefix is hot.
    shared = checkpointed(
        runs.groupBy("seed")
        .agg(F.sum("n").alias("suffixes"), F.sum("seeds").alias("met"))
        .where("met > 1")
        .select("seed", (F.col("suffixes") > group_suffixes).alias("hot"))
    )

    def with_runs(seeds: DataFrame) -> DataFrame:
        # The same columns and left joins throughout: the texts are then shuffled by key only once in a job.
        listed = runs.join(seeds, "seed").groupBy("_key").agg(F.collect_set(F.struct("start", "n", "seed")).alias("runs"))
        return rows.join(listed, "_key", "left").where(F.size("runs") > 0).select("_key", "_id", "text", "runs")

    slices = with_runs(shared.where("not hot").select("seed")).mapInArrow(
        _slices(window), "seed bigint, _key bigint, start int, words array<bigint>"
    )
    ranges = "_key bigint, first int, last int"
    cold = slices.repartition("seed").sortWithinPartitions("seed").mapInArrow(_subtrees(window), ranges)

    # The texts need not be shuffled to find hot seeds in them as long as these are few: 8 bytes each, counted first.
    hottest = shared.where("hot").select("seed")
    suffixes = "p1 bigint, p2 bigint, _key bigint, start int"
    if hottest.count() <= hot_seeds:
        few = np.sort(hottest.toPandas()["seed"].to_numpy(np.int64).view(np.uint64))
        heads = rows.select("_key", "text").mapInArrow(_prefixes_of(few, window, seed), suffixes) if len(few) else None
    else:
        heads = with_runs(hottest).mapInArrow(_whole_prefixes(window), suffixes)
    found = cold
    if heads is not None:
        repeated = checkpointed(heads.groupBy("p1", "p2").count().where("count > 1").drop("count"))
        hot = heads.join(repeated, ["p1", "p2"]).select("_key", F.col("start").alias("first"), F.col("start").alias("last"))
        found = cold.unionByName(hot)

    marks = found.groupBy("_key").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return (
        rows.join(marks, "_key", "left")
        .select("_id", "text", "marks")
        .mapInArrow(_cut(window), f"_id {id_type}, text string, n_words bigint, n_removed bigint")
        .withColumnRenamed("_id", id_col)
    )
