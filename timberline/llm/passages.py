"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage becomes a vector of text statistics
and is encoded by one layer, a gated attention unit gives it a weight, and the score
comes from the weighted mean of the encodings. Only documents are labelled; the
weights show which passages decide, so one spoilt passage in a long text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.samples import labelled_sample
from timberline.llm.words import SpanHasher, column_of, pieces, run_hashes, text_bytes, word_spans

PER_CLASS = 3000
PASSAGE_WORDS = 60
_HIDDEN, _GATE = 16, 8
_STEPS = 300
_RATE = 0.02

# Characters whose share of a passage is a statistic, by class.
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#*$%&@", "|<>{}[]()", "=_/\\~^+-", "\n", "\"'`")
_MEMBER = np.zeros((len(_CLASSES) + 1, 256), np.int32)
for _i, _chars in enumerate(_CLASSES):
    _MEMBER[_i, list(_chars.encode())] = 1
_MEMBER[-1, 128:] = 1
_MARK = np.zeros(256, np.int32)
_MARK[list(b"#*$%&@|<>{}[]=_~^!")] = 1
_LAGS = (1, 2, 3, 4, 6, 8)
WIDTH = len(_MEMBER) + len(_LAGS) + 6


def passage_vectors(texts: pa.Array, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages and, per text, where its passages begin.

    A text without words has one passage of zeros.
    """
    data, offsets = text_bytes(texts)
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    parts = np.maximum(1, -(-n // size))
    begins = np.append(0, np.cumsum(parts))
    out = np.zeros((begins[-1], WIDTH))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], parts)
    low = np.repeat(first[:-1], parts) + at * size
    high = np.minimum(low + size, np.repeat(first[1:], parts))
    full = np.flatnonzero(high > low)
    if not len(full):
        return out, begins
    low, high = low[full], high[full]
    words = (high - low).astype(float)
    begin, end = starts[low], ends[high - 1]
    length = (end - begin).astype(float)
    columns = []
    for member in _MEMBER:
        sums = np.append(0, np.cumsum(member[data]))
        columns.append((sums[end] - sums[begin]) / length)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return (sums[high] - sums[low]) / words

    hashes = SpanHasher(data)(starts, ends)
    text = np.repeat(np.arange(len(n)), n)
    for lag in _LAGS:
        same = np.zeros(len(hashes), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (text[lag:] == text[:-lag])
        columns.append(share(same))
    passage = np.repeat(np.arange(len(full)), high - low)
    columns.append(share(_first_of(passage, hashes)))
    grams = np.append(run_hashes(hashes, 5), np.zeros(min(4, len(hashes)), np.uint64))
    grams[np.arange(len(grams)) + 5 > first[1:][text]] = 0
    fresh = _first_of(text, grams)
    columns.append(share(~fresh & (grams != 0)))
    columns.append(share(_MARK[data[ends - 1]] == 1))
    columns.append(length / words / 10)
    columns.append(np.log1p(words) / 4)
    columns.append(share((ends - starts) <= 2))
    out[full] = np.stack(columns, 1)
    return out, begins


def _first_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a place holds its group's first use of the value."""
    keys = (group.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), bool)
    out[order] = head
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Parameters of encoder, gated attention and output; their number is fixed."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = {
            "W": rng.normal(0, d**-0.5, (d, _HIDDEN)),
            "a": np.zeros(_HIDDEN),
            "V": rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, _GATE)),
            "U": rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, _GATE)),
            "w": rng.normal(0, _GATE**-0.5, _GATE),
            "c": rng.normal(0, _HIDDEN**-0.5, _HIDDEN),
            "b": np.zeros(1),
        }

    def forward(self, vectors: np.ndarray, begins: np.ndarray):
        """Logits of the bags, and what the backward pass needs."""
        p = self.p
        x = np.clip((vectors - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["a"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (tv * su) @ p["w"]
        bag = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        e = np.exp(e - np.maximum.reduceat(e, begins[:-1])[bag])
        alpha = e / np.add.reduceat(e, begins[:-1])[bag]
        z = np.add.reduceat(alpha[:, None] * h, begins[:-1], axis=0)
        return z @ p["c"] + p["b"][0], (x, h, tv, su, alpha, bag, z)

    def gradients(self, error: np.ndarray, state, begins: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, tv, su, alpha, bag, z = state
        dz = error[:, None] * p["c"]
        dh = alpha[:, None] * dz[bag]
        dalpha = (dz[bag] * h).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, begins[:-1])[bag])
        dgate = de[:, None] * p["w"]
        dv = dgate * su * (1 - tv**2)
        du = dgate * tv * su * (1 - su)
        dh += dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h**2)
        return {
            "W": x.T @ dx,
            "a": dx.sum(0),
            "V": h.T @ dv,
            "U": h.T @ du,
            "w": (tv * su).T @ de,
            "c": z.T @ error,
            "b": error.sum(keepdims=True),
        }

    def scores(self, texts: pa.Array, size: int = PASSAGE_WORDS) -> np.ndarray:
        if len(texts) == 0:
            return np.empty(0)
        vectors, begins = passage_vectors(texts, size)
        return _sigmoid(self.forward(vectors, begins)[0])

    def attention(self, text: str, size: int = PASSAGE_WORDS) -> np.ndarray:
        """The weights of one text's passages."""
        vectors, begins = passage_vectors(pa.array([text]), size)
        return self.forward(vectors, begins)[1][4]

    def column(self, text: Column) -> Column:
        return column_of(lambda texts: pa.array(self.scores(texts), pa.float64()), "double")(text)


def fit_bags(vectors: np.ndarray, begins: np.ndarray, label: np.ndarray, steps: int = _STEPS) -> Model:
    """Fit to bags of passages by their labels alone."""
    rng = np.random.default_rng(5)
    if len(label) == 0:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), rng)
    model = Model(vectors.mean(0), vectors.std(0) + 1e-3, rng)
    if label.min() == label.max():
        model.p["c"][:] = 0
        model.p["b"][0] = 4.0 if label[0] else -4.0
        return model
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(label)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        logit, state = model.forward(vectors, begins)
        grads = model.gradients((_sigmoid(logit) - label) * weight, state, begins)
        for k, g in grads.items():
            g = g + 1e-4 * model.p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            model.p[k] -= _RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return model


def _bags(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            vectors, begins = passage_vectors(piece.column("text"), size)
            yield pa.record_batch(
                {
                    "_id": piece.column("_id"),
                    "label": piece.column("label"),
                    "bag": pa.ListArray.from_arrays(
                        pa.array(begins * WIDTH, pa.int32()), pa.array(vectors.reshape(-1).astype(np.float32))
                    ),
                }
            )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = PER_CLASS,
    size: int = PASSAGE_WORDS,
) -> Model:
    """Fit on at most ``per_class`` labelled documents of either label (the bound of the sample).

    ``labels`` holds (``id_col``, ``label``); null ids, null labels and labels other than 0 and 1
    are ignored, a null text counts as empty, and other columns are not read. Without labels of
    both kinds the score is the same for every text, 0.5 if there are none.
    """
    sample = labelled_sample(docs, labels, per_class, id_col, text_col)
    id_type = sample.schema["_id"].dataType.simpleString()
    rows = (
        sample.select("_id", "label", "text")
        .mapInArrow(_bags(size), f"_id {id_type}, label int, bag array<float>")
        .toPandas()
        .sort_values("_id")
    )
    bags = [np.asarray(b, float).reshape(-1, WIDTH) for b in rows["bag"]]
    begins = np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64)
    label = rows["label"].to_numpy(np.int64)
    model = fit_bags(np.concatenate([*bags, np.empty((0, WIDTH))]), begins, label)
    if not len(label):
        model.p["c"][:] = 0
    return model
