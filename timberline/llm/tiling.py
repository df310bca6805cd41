"""Benchmark decontamination by greedy string tiling.

A document is compared with the benchmark items with which it shares a seed, a run of
``min_match`` words. For such a pair the longest run of words that both hold and that is not yet
marked is marked in both, again and again, until none of ``min_match`` words is left. Matches
come from rolling (Karp-Rabin) hashes of all runs. The tiles need not be in order, so a
passage whose sentences were moved about is caught by its coverage: the share of the
item's words that tiles cover.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.rows import carried, unpacked
from timberline.llm.words import hashed_words, pieces, run_hashes, signed
from timberline.session import checkpointed

MIN_MATCH = 5
COVERAGE = 0.5
# The seed filter sent to the tasks: two tables of so many bits, whatever the size of the
# benchmark. A seed has a place in each by other bits of its hash.
FILTER_PLACES = 1 << 22
_PAIRS = 1 << 20  # equal seeds listed at a time


def _maximal(grams_i: np.ndarray, grams_t: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(place in the item, place in the text, words) of all maximal matches of ``size`` words or more.

    Equal seeds are listed for a few places of the item at a time, ``_PAIRS`` of them or those of one place, and what
    goes on along a diagonal is carried over, so memory follows the text's length and not the product of both."""
    order = np.argsort(grams_t, kind="stable")
    low = np.searchsorted(grams_t[order], grams_i, side="left")
    count = np.searchsorted(grams_t[order], grams_i, side="right") - low
    upto = np.cumsum(count)
    found: list[tuple[int, int, int]] = []
    open_d, open_i = np.empty(0, np.int64), np.empty(0, np.int64)  # diagonals of matches that may go on, and where they began

    def close(diagonals: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        found.extend(zip(starts.tolist(), (starts + diagonals).tolist(), (ends - starts + size - 1).tolist()))

    at = 0
    while at < len(grams_i):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + _PAIRS, side="right")))
        here = count[at:to]
        i = np.repeat(np.arange(at, to), here)
        within = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
        d = order[np.repeat(low[at:to], here) + within] - i
        by = np.argsort(d, kind="stable")  # by diagonal, then by place
        i, d = i[by], d[by]
        head = np.ones(len(i), bool)
        head[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
        heads = np.flatnonzero(head)
        starts, diagonals = i[heads], d[heads]
        ends = starts + np.diff(np.append(heads, len(i)))
        # Matches of the places before that reach up to here, by diagonal like those found here.
        first = np.flatnonzero(starts == at)
        place = np.searchsorted(diagonals[first], open_d)
        goes_on = np.zeros(len(open_d), bool)
        inside = place < len(first)
        goes_on[inside] = diagonals[first][place[inside]] == open_d[inside]
        close(open_d[~goes_on], open_i[~goes_on], np.full(int((~goes_on).sum()), at))
        starts = starts.copy()
        starts[first[place[goes_on]]] = open_i[goes_on]
        last = ends == to
        close(diagonals[~last], starts[~last], ends[~last])
        open_d, open_i = diagonals[last], starts[last]
        at = to
    close(open_d, open_i, np.full(len(open_d), len(grams_i)))
    return found


def tile(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> np.ndarray:
    """Lengths of the tiles that cover ``item`` (hashed words), longest first."""
    size = min(min_match, len(item))
    if size == 0 or len(text) < size:
        return np.empty(0, np.int64)
    grams_i, grams_t = run_hashes(item, size), run_hashes(text, size)
    matches = [(-n, a, b) for a, b, n in _maximal(grams_i, grams_t, size)]
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    heapq.heapify(matches)
    tiles = []
    while matches:
        n, a, b = heapq.heappop(matches)
        n = -n
        free = free_i[a : a + n] & free_t[b : b + n]
        if free.all():
            free_i[a : a + n] = False
            free_t[b : b + n] = False
            tiles.append(n)
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= size:
                heapq.heappush(matches, (start - end, a + start, b + start))
    return np.array(tiles, np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        words = hashed_words(piece.column("text"), lower=True)
        yield pa.record_batch(
            {
                "_item": piece.column("_item"),
                "words": pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(signed(words.hashes))),
            }
        )


def _item_seeds(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, seeds = [], [], []
            for item, words in zip(batch.column("_item").to_pylist(), batch.column("words")):
                words = words.values.to_numpy().view(np.uint64)
                size = min(min_match, len(words))
                found = signed(np.unique(run_hashes(words, size))) if size else []
                items += [item] * len(found)
                sizes += [size] * len(found)
                seeds.append(found)
            flat = np.concatenate([*seeds, np.empty(0, np.int64)])
            yield pa.record_batch(
                {"_item": pa.array(items, batch.schema.field("_item").type), "size": pa.array(sizes, pa.int32()), "seed": pa.array(flat, pa.int64())}
            )

    return run


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes in the two tables of the filter."""
    bits = np.uint64(FILTER_PLACES.bit_length() - 1)
    mask = np.uint64(FILTER_PLACES - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> bits) & mask).astype(np.int64)


def _filter(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tables, as packed bits; at most ``FILTER_PLACES`` places of each are collected."""
    bits = FILTER_PLACES.bit_length() - 1
    tables = []
    for shift in (0, bits):
        place = F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(FILTER_PLACES - 1)).cast("int")
        table = np.zeros(FILTER_PLACES, np.uint8)
        table[seeds.select(place.alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)] = 1
        tables.append(np.packbits(table))
    return tables[0], tables[1]


def _met(sizes: list[int], tables: tuple[np.ndarray, np.ndarray]):
    """Texts with a run that the seed filter knows, and those runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (np.unpackbits(t).astype(bool) for t in tables)
        for piece in pieces(batches):
            words = hashed_words(piece.column("text"), lower=True)
            ends = words.ends()
            text = np.repeat(np.arange(piece.num_rows), words.counts())
            rows, seeds = [], []
            for size in sizes:
                grams = run_hashes(words.hashes, size)
                first, second = _places(grams)
                at = np.flatnonzero(one[first] & two[second])
                at = at[at + size <= ends[at]]
                rows.append(text[at])
                seeds.append(grams[at])
            row, seed = np.concatenate([*rows, np.empty(0, np.int64)]), np.concatenate([*seeds, np.empty(0, np.uint64)])
            order = np.lexsort((seed, row))
            row, seed = row[order], seed[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
            row, seed = row[new], seed[new]
            met = np.unique(row)
            yield pa.record_batch(
                {
                    "_key": piece.column("_key").take(pa.array(met)),
                    "text": piece.column("text").take(pa.array(met)),
                    "seeds": pa.ListArray.from_arrays(
                        pa.array(np.append(np.searchsorted(row, met), len(row)), pa.int32()), pa.array(signed(seed), pa.int64())
                    ),
                }
            )

    return run


def _covered(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = hashed_words(piece.column("text"), lower=True)
            items, item_words = piece.column("_item"), piece.column("words")
            share = []
            for i in range(piece.num_rows):
                item = item_words[i].values.to_numpy().view(np.uint64)
                text = words.hashes[words.first[i] : words.first[i + 1]]
                share.append(float(tile(item, text, min_match).sum() / len(item)))
            yield pa.record_batch({"_key": piece.column("_key"), "_item": items, "coverage": pa.array(share, pa.float64())})

    return run


def coverage(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
) -> DataFrame:
    """(``_key``, ``_item``, ``coverage``) of every document and item that share a seed.

    ``_key`` is the hash of a document's id and text. Only documents that pass a
    filter of fixed size over the benchmark's seeds leave the scan; whether seeds and items
    are broadcast or shuffled is Spark's choice by their size.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select(F.xxhash64("_id", "text").alias("_key"), "text")
    items = benchmark.select(F.col(f"`{item_col}`").alias("_item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    item_type = items.schema["_item"].dataType.simpleString()
    items = checkpointed(items.mapInArrow(_item_words, f"_item {item_type}, words array<bigint>").where(F.size("words") > 0).distinct())
    seeds = checkpointed(items.mapInArrow(_item_seeds(min_match), f"_item {item_type}, size int, seed bigint"))

    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # min_match values at most
    met = checkpointed(
        rows.mapInArrow(_met(sizes, _filter(seeds)), "_key bigint, text string, seeds array<bigint>").dropDuplicates(["_key"])
    )
    pairs = met.select("_key", F.explode("seeds").alias("seed")).join(seeds.select("seed", "_item"), "seed")
    pairs = pairs.select("_key", "_item").distinct()
    whole = pairs.join(items, pairs["_item"].eqNullSafe(items["_item"])).select("_key", pairs["_item"], "words")
    return (
        met.select("_key", "text").join(whole, "_key")
        .mapInArrow(_covered(min_match), f"_key bigint, _item {item_type}, coverage double")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = COVERAGE,
) -> DataFrame:
    """Which documents hold a benchmark item, one row per input row.

    Returns (``id_col``, ``n_items`` (items with coverage of at least ``threshold``), ``item_id``
    (the best covered one, the least on a tie; null without a seed), ``coverage``, ``kept``).
    Words are compared with A-Z folded. An item of fewer than ``min_match`` words must
    be found as a whole; an item without words and a null or empty document never match. Items that
    repeat count once. Null ids and repeated rows are rows like others. Other columns are not
    read. An empty benchmark keeps all; an empty table gives an empty table.
    """
    found = coverage(docs, benchmark, id_col, text_col, item_col, item_text_col, min_match)
    best = found.groupBy("_key").agg(
        F.count_if(F.col("coverage") >= threshold).alias("n_items"),
        F.min(F.struct((-F.col("coverage")).alias("less"), "_item")).alias("best"),
    )
    keys = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).alias("_key"))
    return keys.join(best, "_key", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best._item").alias("item_id"),
        F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("coverage"),
        (F.coalesce("n_items", F.lit(0)) == 0).alias("kept"),
    )


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = COVERAGE,
    min_match: int = MIN_MATCH,
) -> DataFrame:
    """The rows of ``docs`` without an item of coverage ``threshold`` or more, all columns."""
    found = coverage(docs, benchmark, id_col, text_col, min_match=min_match).where(F.col("coverage") >= threshold)
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return unpacked(carried(docs, key).join(found.select("_key").distinct(), F.col("key") == F.col("_key"), "left_anti"), docs)
