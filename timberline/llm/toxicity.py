"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings (hashed). Besides
the labels it is fitted to counterfactuals: in every sampled text that names an
identity, each identity term is swapped for another of its group, and the squared
difference of the two logits is added to the loss. A term that merely co-occurs with abuse
in the labelled data so cannot raise a score by itself, and neutral mentions of a
group pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.samples import label_counts, labelled_sample
from timberline.llm.words import LOWER, SpanHasher, column_of, mix, pieces, spans, text_bytes

PER_CLASS = 4000
PENALTY = 1.0
BITS = 18
_STARTS = (4, 5)  # bytes of a word's beginning that are a feature of their own
_RIDGE = 1e-4
_STEPS = 300
_EVIDENCE = 12.0  # chi-square below which a feature is left out

IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word beginning, with repeats."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends = spans(_LETTER[data], offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashed = SpanHasher(data)
    shift = np.uint64(64 - bits)
    rows, buckets = [text], [hashed(starts, ends) >> shift]
    for size in _STARTS:
        longer = np.flatnonzero(ends - starts > size)
        rows.append(text[longer])
        buckets.append(mix(hashed(starts[longer], starts[longer] + size) ^ np.uint64(size)) >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def _distinct(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((rows.astype(np.int64) << bits) | buckets)
    return keys >> bits, keys & ((1 << bits) - 1)


def swapper(groups: Sequence[Sequence[str]]):
    """A function that swaps every identity term for the next one of its group."""
    other = {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}
    if not other:
        return lambda text: text
    found = re.compile(r"\b(" + "|".join(map(re.escape, sorted(other, key=len, reverse=True))) + r")\b", re.IGNORECASE)
    return lambda text: found.sub(lambda m: other[m[0].lower()], text)


def _examples(groups: Sequence[Sequence[str]], bits: int):
    swap = swapper(groups)

    def lists(texts: list[str]) -> pa.Array:
        rows, buckets = _distinct(*features(pa.array(texts, pa.string()), bits), bits)
        at = np.searchsorted(rows, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(buckets, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            swapped = [swap(t) for t in texts]
            yield pa.record_batch(
                {
                    "_id": piece.column("_id"),
                    "label": piece.column("label"),
                    "own": lists(texts),
                    "swapped": lists([s if s != t else "" for s, t in zip(swapped, texts)]),
                    "named": pa.array([s != t for s, t in zip(swapped, texts)]),
                }
            )

    return run


class Model:
    """Weights by bucket and a bias; the table has ``2**bits`` numbers whatever the corpus."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        bits = int(len(self.weights)).bit_length() - 1
        rows, buckets = features(texts, bits)
        told = np.flatnonzero(self.weights[buckets])
        rows, buckets = _distinct(rows[told], buckets[told], bits)
        logit = self.bias + np.bincount(rows, self.weights[buckets].astype(np.float64), len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def column(self, text: Column) -> Column:
        return column_of(lambda texts: pa.array(self.scores(texts), pa.float64()), "double")(text)


def _flat(lists: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists), dtype=np.int32), sizes), np.concatenate([*lists, np.empty(0, np.int32)])


def fit_examples(
    own: Sequence[np.ndarray], swapped: Sequence[np.ndarray], named: np.ndarray, label: np.ndarray, bits: int, penalty: float
) -> Model:
    """Fit to the buckets of each text and of its counterfactual (used where ``named``)."""
    weights = np.zeros(1 << bits)
    n = len(label)
    if n == 0 or label.min() == label.max():  # nothing to tell apart
        return Model(weights, 0.0 if n == 0 else (4.0 if label[0] else -4.0))
    toxic, seen = (np.zeros(1 << bits) for _ in range(2))
    for buckets, y in zip(own, label.tolist()):  # a text's buckets are distinct
        seen[buckets] += 1
        toxic[buckets] += y
    share = label.mean()
    expected = seen * share
    evidence = (toxic - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - seen / (n + 1)), 1e-9)
    used = np.flatnonzero((evidence >= _EVIDENCE) & (seen >= 3))
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))

    def matrix(lists):
        r, c = _flat([at[at >= 0] for at in (place[x] for x in lists)])
        return r, c

    rows, cols = matrix(own)
    pairs = np.flatnonzero(named)
    rows_a, cols_a = matrix([own[i] for i in pairs])
    rows_b, cols_b = matrix([swapped[i] for i in pairs])
    w, m, v = (np.zeros(len(used) + 1) for _ in range(3))  # the last one is the bias
    for step in range(1, _STEPS + 1):
        logit = w[-1] + np.bincount(rows, w[cols], n)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label) / n
        grad = np.append(np.bincount(cols, error[rows], len(used)) + _RIDGE * w[:-1], error.sum())
        if len(pairs):
            gap = np.bincount(rows_a, w[cols_a], len(pairs)) - np.bincount(rows_b, w[cols_b], len(pairs))
            gap *= 2 * penalty / len(pairs)
            grad[:-1] += np.bincount(cols_a, gap[rows_a], len(used)) - np.bincount(cols_b, gap[rows_b], len(used))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights[used] = w[:-1]
    return Model(weights, w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = PER_CLASS,
    groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
    penalty: float = PENALTY,
    bits: int = BITS,
) -> Model:
    """Fit on at most ``per_class`` labelled documents of either label (the bound of the sample).

    ``labels`` holds (``id_col``, ``label``); null ids, null labels and labels other than 0 and 1
    are ignored, a null text counts as empty, and other columns are not read. Without labels of
    both kinds the score is the same for every text. Where the sample takes another share of one label
    than of the other, the bias is set back to the shares of all labels.
    """
    sample = labelled_sample(docs, labels, per_class, id_col, text_col)
    id_type = sample.schema["_id"].dataType.simpleString()
    rows = (
        sample.select("_id", "label", "text")
        .mapInArrow(_examples(groups, bits), f"_id {id_type}, label int, own array<int>, swapped array<int>, named boolean")
        .toPandas()
        .sort_values("_id")
    )
    label = rows["label"].to_numpy(np.int64)
    model = fit_examples(list(rows["own"]), list(rows["swapped"]), rows["named"].to_numpy(bool), label, bits, penalty)
    if len(label) and label.min() != label.max():
        # The odds of a label in the sample, over those among all labels, are the odds of its being drawn.
        drawn = {c: min(n, per_class) / n for c, n in label_counts(labels, id_col).items()}
        model.bias += float(np.log(drawn[0] / drawn[1]))
    return model


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns unchanged."""
    score = model.column(F.col(f"`{text_col}`").cast("string"))
    return docs.where(score < threshold)
