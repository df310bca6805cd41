"""Line dedup by a log-template tree.

The tree has a fixed depth: lines are parsed by their number of tokens and then by their
``depth`` leading tokens, a token with a digit counting as a variable field. Inside a leaf the
token at a position has a rank by the share of the leaf's documents that have it there: rank r is a
share of 1 / 2**r or more. A token that fewer than ``min_docs`` documents have there is a
variable field at any rank. A line's template holds its positions up to the lowest rank at which
enough of them are constant; the others are variable fields. So fields are told by shares, and lines have the
same template in a corpus of any size. A template that recurs in ``min_docs`` documents or more is
boilerplate, and its lines are dropped. (Templates of higher ranks are not asked for: lines that
share one share that of the lowest rank too.)

Nothing depends on the order of lines. Leaves that fewer documents share are left out after
one count; the tokens of the rest are counted once for each distinct line, with partial sums
before the shuffle, so a line in a third of all documents is one row. What lines of one document have in
common is taken off again, so that documents are counted and not lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.words import SpanHasher, mix, pieces, range_hashes, signed, text_bytes, word_spans
from timberline.session import checkpointed

DEPTH = 3
MIN_DOCS = 4
CONSTANT = 0.6
FIELD = "<*>"

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD_HASH = np.uint64(0x6A09E667F3BCC909)


def _in_text(text: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One hash of a text's number and a line."""
    return mix(line ^ mix(text.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))


class _Lines:
    """Lines with a token, over all texts of a piece."""

    def __init__(self, texts: pa.Array, depth: int):
        data, offsets = text_bytes(texts)
        starts, ends = word_spans(data, offsets)
        tokens = SpanHasher(data)(starts, ends)
        digits = np.append(0, np.cumsum(_DIGIT[data]))
        tokens[digits[ends] > digits[starts]] = _FIELD_HASH
        self.tokens = tokens
        breaks = np.append(0, np.cumsum(data == 10))
        text = np.searchsorted(offsets, starts, side="right") - 1
        line = breaks[starts]  # number of line breaks before, over the whole piece
        head = np.ones(len(starts), bool)
        head[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        self.first = np.flatnonzero(head)
        self.count = np.diff(np.append(self.first, len(starts)))
        self.text = text[self.first]
        self.number = line[self.first] - breaks[offsets[:-1]][self.text]
        parts = [self.count.astype(np.uint64)]
        for k in range(depth):
            at = np.minimum(self.first + k, max(0, len(tokens) - 1))
            parts.append(np.where(self.count > k, tokens[at], np.uint64(k)) if len(tokens) else tokens)
        leaf = np.zeros(len(self.first), np.uint64)
        for part in parts:
            leaf = mix(leaf ^ mix(part + np.uint64(0x9E3779B97F4A7C15)))
        self.leaf = leaf
        self.line = mix(leaf ^ range_hashes(tokens, self.first, self.first + self.count))

    def listed(self, lists: pa.Array) -> np.ndarray:
        """Which lines are in their text's list of line hashes."""
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        hashes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return np.isin(_in_text(self.text, self.line), _in_text(row, hashes))


def _line_keys(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            lines = _Lines(piece.column("text"), depth)
            keys = piece.column("_key").to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                {
                    "_key": pa.array(keys[lines.text], pa.int64()),
                    "leaf": pa.array(signed(lines.leaf)),
                    "line": pa.array(signed(lines.line)),
                }
            )

    return run


def _repeats(text: np.ndarray, leaf: np.ndarray, count: np.ndarray, tokens: np.ndarray):
    """(leaf, place, token, documents counted too often) where lines of one text agree."""
    several = np.unique(_in_text(text, leaf), return_inverse=True, return_counts=True)
    many = several[2][several[1]] > 1
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(np.repeat(many, count))
    line = np.repeat(np.arange(len(count)), count)[at]
    place, tokens = place[at], tokens[at]
    name = mix(tokens ^ mix(leaf[line] ^ mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))))
    texts, first, met = np.unique(_in_text(text[line], name), return_index=True, return_counts=True)
    first, extra = first[met > 1], met[met > 1] - 1
    _, one, group = np.unique(name[first], return_index=True, return_inverse=True)
    total = np.bincount(group, weights=extra, minlength=len(one)).astype(np.int64)
    first = first[one]
    return leaf[line[first]], place[first], tokens[first], total


def _line_tokens(depth: int):
    """The tokens of the lines asked for, once per text, and :func:`_repeats` with its count below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            lines = _Lines(piece.column("text"), depth)
            at = np.flatnonzero(lines.listed(piece.column("lines")))
            at = at[np.unique(_in_text(lines.text[at], lines.line[at]), return_index=True)[1]]
            count = lines.count[at]
            ends = np.cumsum(count)
            index = np.arange(count.sum()) + np.repeat(lines.first[at] - (ends - count), count)
            leaf, place, token, extra = _repeats(lines.text[at], lines.leaf[at], count, lines.tokens[index])
            n, more = len(at), len(leaf)
            off = np.arange(n + more) >= n
            yield pa.record_batch(
                {
                    "leaf": pa.array(signed(np.append(lines.leaf[at], leaf)), pa.int64()),
                    "line": pa.array(signed(np.append(lines.line[at], leaf)), pa.int64(), mask=off),
                    "place": pa.array(np.append(np.zeros(n, np.int32), place.astype(np.int32)), mask=~off),
                    "tokens": pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends, ends[-1:].sum() + np.arange(1, more + 1)]), pa.int32()),
                        pa.array(signed(np.append(lines.tokens[index], token)), pa.int64()),
                    ),
                    "docs": pa.array(np.append(np.ones(n, np.int64), -extra), pa.int64()),
                }
            )

    return run


def _without(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            lines = _Lines(piece.column("text"), depth)
            total = np.bincount(lines.text, minlength=piece.num_rows)
            dropped = np.flatnonzero(lines.listed(piece.column("lines")))
            gone: list[set[int]] = [set() for _ in range(piece.num_rows)]
            for text, number in zip(lines.text[dropped].tolist(), lines.number[dropped].tolist()):
                gone[text].add(number)
            kept = []
            for text, out in zip(piece.column("text").to_pylist(), gone):
                text = text or ""
                kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in out) if out else text)
            yield pa.record_batch(
                {
                    "_id": piece.column("_id"),
                    "text": pa.array(kept, pa.string()),
                    "n_lines": pa.array(total, pa.int64()),
                    "n_dropped": pa.array([len(x) for x in gone], pa.int64()),
                }
            )

    return run


def drop_templates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    constant: float = CONSTANT,
) -> DataFrame:
    """Drop all lines whose template recurs in ``min_docs`` documents or more.

    Returns (``id_col``, ``text``, ``n_lines`` (lines with a token), ``n_dropped``), one row per
    input row. Lines end at ``\\n``; lines without a token stay. A null text comes back
    empty. Rows equal in id and text are one document for the counts and are each returned;
    a null id is an id like others. Other columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select(F.xxhash64("_id", "text").alias("_key"), "_id", "text")
    lines = rows.select("_key", "text").mapInArrow(_line_keys(depth), "_key bigint, leaf bigint, line bigint")
    leaves = checkpointed(
        lines.select("leaf", "_key").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("leaf_docs"))
        .where(F.col("leaf_docs") >= min_docs)
    )
    shared = checkpointed(lines.join(leaves.select("leaf"), "leaf").distinct())

    def with_lines(found: DataFrame) -> DataFrame:
        # The same columns and left joins in both places: the texts are then shuffled only once.
        return rows.join(found.groupBy("_key").agg(F.collect_set("line").alias("lines")), "_key", "left")

    # Lines with their tokens and documents; rows without a line take documents off one token's count.
    counted = checkpointed(
        with_lines(shared).where(F.size("lines") > 0).dropDuplicates(["_key"]).select("_id", "text", "lines")
        .mapInArrow(_line_tokens(depth), "leaf bigint, line bigint, place int, tokens array<bigint>, docs bigint")
        .withColumn("token", F.when(F.col("line").isNull(), F.col("tokens")[0]))
        .groupBy("leaf", "line", "place", "token").agg(F.first("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    )
    distinct = counted.where(F.col("line").isNotNull()).select("leaf", "line", "tokens", "docs")
    places = distinct.select("leaf", "line", "docs", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token"))
    repeats = counted.where(F.col("line").isNull()).select("leaf", "place", "token", "docs")
    ranked = (
        places.select("leaf", "place", "token", "docs").union(repeats)
        .groupBy("leaf", "place", "token").agg(F.sum("docs").alias("met")).where(F.col("met") >= min_docs)
        .join(leaves, "leaf")
        .select("leaf", "place", "token", F.ceil(F.log2(F.col("leaf_docs") / F.col("met")) - 1e-9).cast("int").alias("rank"))
    )
    enough = F.greatest(F.lit(1), F.ceil(F.lit(constant) * F.col("size"))).cast("int")
    templates = (
        places.join(ranked, ["leaf", "place", "token"])
        .groupBy("leaf", "line")
        .agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "place", "token"))).alias("fixed"))
        .where(F.size("fixed") >= enough)
        .withColumn("rank", F.element_at("fixed", enough)["rank"])
        .select("line", F.xxhash64("leaf", F.filter("fixed", lambda x: x["rank"] <= F.col("rank"))).alias("template"))
    )
    placed = shared.select("_key", "line").join(templates, "line")
    recurring = placed.select("template", "_key").distinct().groupBy("template").count().where(F.col("count") >= min_docs)
    dropped = placed.join(recurring.select("template"), "template").select("_key", "line")
    id_type = rows.schema["_id"].dataType.simpleString()
    return (
        with_lines(dropped)
        .select("_id", "text", "lines")
        .mapInArrow(_without(depth), f"_id {id_type}, text string, n_lines bigint, n_dropped bigint")
        .withColumnRenamed("_id", id_col)
    )
