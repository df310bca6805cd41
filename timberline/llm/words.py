"""Words, word hashes and hashes of word runs over whole Arrow batches.

A word is a run of ``[^\\x20\\x09-\\x0D]+``, that is what ``bytes.split()`` gives
for UTF-8 text. All functions are vectorised over the concatenated texts of a
batch, so their cost is a few numpy passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

WORD = r"[^\x20\x09-\x0D]+"

# Texts are handled in pieces of about this many bytes (one text at least).
PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_CHARS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1B54A32D192ED03, "other": 0x2545F4914F6CDD1D}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""
    found = _TABLES.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for value in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
            table = np.full(size, value, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        _TABLES[base] = found = (made[0], made[1])
    return found


def _sums(values: np.ndarray, base: str) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def run_hashes(words: np.ndarray, k: int, base: str = "word") -> np.ndarray:
    """Hash of ``words[i:i+k]`` for every i, across text borders too."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    sums = _sums(words, base)
    inverse = _powers(base, len(words) + 1)[1]
    return mix((sums[k:] - sums[:-k]) * inverse[: len(words) - k + 1])


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: str = "word") -> np.ndarray:
    """Hash of ``words[starts[i]:ends[i]]`` for every i."""
    sums = _sums(words, base)
    return mix((sums[ends] - sums[starts]) * _powers(base, len(words) + 1)[1][starts])


@dataclass
class Words:
    """Hashed words of several texts, one after the other.

    Text ``i`` owns ``hashes[first[i]:first[i + 1]]``.
    """

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def ends(self) -> np.ndarray:
        """For every word, the index behind the last word of its text."""
        return np.repeat(self.first[1:], self.counts())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, none across a text border."""
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    beside = np.zeros(len(inside), bool)
    beside[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~beside | border[:-1]))
    beside[-1:] = False
    beside[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~beside | border[1:])) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans(~_SPACE[data], offsets)


class SpanHasher:
    """Hashes of any byte ranges of ``data`` after one pass over it."""

    def __init__(self, data: np.ndarray):
        self._inverse = _powers("byte", len(data) + 1)[1]
        self._sums = _sums(_CHARS[data], "byte")

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


def hashed_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; ``lower`` folds A-Z."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    return Words(SpanHasher(data)(starts, ends), np.searchsorted(starts, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed integers that Spark stores."""
    return values.view(np.int64)


def column_of(function, returns: str):
    """A column function of texts from ``function(texts) -> pa.Array``, which gets pieces of bounded size."""

    @arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        whole = pa.record_batch({"text": texts})
        return pa.concat_arrays([function(piece.column("text")) for piece in pieces(iter([whole]))])

    return run
