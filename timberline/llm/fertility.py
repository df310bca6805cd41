"""Quality rules by tokeniser fertility.

A public vocabulary encodes every word of a text by itself. Three measures follow:
characters per token, the share of byte-fallback tokens, and the entropy of the
text's tokens. What is normal depends on the language or script and on the length,
so the bands are taken from the documents of the same language (or, where that is null, of
the same script) and length class: quartiles widened by ``SPREAD`` times their distance. Where these
are too few, wider groups decide: the language, the script, all documents. The entropy depends on
the length before all, so there length classes nearby come first, of the language, of the script and of
all documents. All documents together have bands however few they are, so each one is judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.vocab import public_path, vocabulary
from timberline.llm.words import column_of, hashed_words, run_hashes
from timberline.session import checkpointed

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of words in repeated windows
SPREAD = 4.0
LEAST_WIDTH = {"chars_per_token": 0.4, "fallback_share": 0.05, "entropy": 0.6}
MIN_GROUP = 50  # documents a group needs to have bands of its own
NEAR = 2  # length classes nearby that bands of the entropy may take in

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "n_tokens:bigint,chars_per_token:double,fallback_share:double,entropy:double>"
)


def repeated_words(words: np.ndarray, size: int = 5) -> int:
    """Words inside runs of ``size`` words that the text holds twice or more, the first included."""
    if len(words) <= size:
        return 0
    grams = run_hashes(words, size)
    _, name, count = np.unique(grams, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[name] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    edge[twice + size] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _measured(path: str):
    def run(texts: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        fallback = np.zeros(vocab.size, bool)
        fallback[vocab.special] = True
        raw = [(t or "").encode() for t in texts.to_pylist()]
        split = [t.split() for t in raw]
        table = vocab.learn({w for words in split for w in words})
        hashed = hashed_words(texts)
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")}
        rates = {k: [] for k in ("chars_per_token", "fallback_share", "entropy")}
        for i, (text, words) in enumerate(zip(raw, split)):
            data = np.frombuffer(b"".join(words), np.uint8)
            chars = int(np.count_nonzero((data & 0xC0) != 0x80))
            tokens = np.frombuffer(b"".join([table[w] for w in words]), vocab.dtype)
            n = len(tokens)
            out["n_words"].append(len(words))
            out["word_chars"].append(chars)
            out["n_symbols"].append(int(np.count_nonzero(_SYMBOL[data])))
            out["n_dup_lines"].append(duplicate_lines(text))
            out["n_repeat_words"].append(repeated_words(hashed.hashes[hashed.first[i] : hashed.first[i + 1]]))
            out["n_tokens"].append(n)
            rates["chars_per_token"].append(chars / n if n else 0.0)
            rates["fallback_share"].append(float(fallback[tokens].mean()) if n else 0.0)
            rates["entropy"].append(entropy(tokens))
        columns = [pa.array(v, pa.int64()) for v in out.values()] + [pa.array(v, pa.float64()) for v in rates.values()]
        return pa.StructArray.from_arrays(columns, names=[*out, *rates])

    return run


def entropy(tokens: np.ndarray) -> float:
    """Bits a token of a text, 0 without tokens."""
    if not len(tokens):
        return 0.0
    count = np.unique(tokens, return_counts=True)[1] / len(tokens)
    return float(-(count * np.log2(count)).sum()) + 0.0


def script(text: Column) -> Column:
    """The script of a text's first letters: a coarse stand-in for a language."""
    letters = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\p{L})", 1)
    found = F.lit("other")
    for name in ("Han", "Arabic", "Cyrillic", "Greek", "Latin"):
        found = F.when(letters.rlike(rf"\p{{Is{name}}}"), name.lower()).otherwise(found)
    return found


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", path: str | None = None
) -> DataFrame:
    """(``_id``, ``_group``, ``_script``, measures) of every row; see :func:`fertility_rules`."""
    text = F.col(f"`{text_col}`").cast("string")
    measure = column_of(_measured(path or public_path(VOCABULARY)), MEASURES)
    written = F.concat(F.lit("script "), script(text))
    group = written
    if lang_col:
        group = F.coalesce(F.concat(F.lit("lang "), F.col(f"`{lang_col}`").cast("string")), group)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), group.alias("_group"), written.alias("_script"), measure(text).alias("_m"))
    return rows.select("_id", "_group", "_script", "_m.*")


CLASS = ("_group", "_script", "_length")


def _levels(measure: str, reach: bool) -> list[Column]:
    """The groups whose bands a class of documents takes, the first with enough documents, or, with
    ``reach``, those to whose bands it adds."""
    steps = [("_group", 0)]
    if measure == "entropy":
        steps += [(by, near) for by in ("_group", "_script", None) for near in range(NEAR + 1) if (by, near) != steps[0]]
    else:
        steps += [("_group", None), ("_script", None)]
    steps.append((None, None))
    out = []
    for level, (by, near) in enumerate(steps):
        # A language may be called like a script's group, so they are told apart by the level.
        key = F.col(by) if by else F.lit("")
        for off in [0] if not near or not reach else range(-near, near + 1):
            length = F.lit(-1) if near is None else F.col("_length") + off
            last = F.lit(level == len(steps) - 1)
            out.append(F.struct(F.lit(level).alias("level"), key.alias("key"), length.cast("int").alias("length"), last.alias("last")))
    return out


def bands(rows: DataFrame, spread: float, min_group: int) -> DataFrame:
    """(``CLASS``, a struct of ``low`` and ``high`` for each measure), one row per class of documents.

    Measures are rounded before their quartiles are taken, so a class is a table of
    counts by value, which does not grow with the documents, and wider groups add up such tables.
    """
    classes = checkpointed(rows.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("_docs"))).drop("_docs")
    found = classes
    for name in LEAST_WIDTH:
        values = rows.groupBy(*CLASS, F.round(name, 2).alias("value")).agg(F.count(F.lit(1)).alias("docs"))
        q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("docs"))
        width = F.greatest((q[1] - q[0]) * spread, F.lit(LEAST_WIDTH[name]))
        table = (
            values.select("value", "docs", F.explode(F.array(*_levels(name, True))).alias("at"))
            .groupBy("at")
            .agg(F.sum("docs").alias("docs"), F.struct((q[0] - width).alias("low"), (q[1] + width).alias("high")).alias("band"))
            .where((F.col("docs") >= min_group) | F.col("at.last"))
        )
        chosen = (
            classes.select(*CLASS, F.explode(F.array(*_levels(name, False))).alias("at"))
            .join(table, "at")
            .groupBy(*CLASS)
            .agg(F.min_by("band", "at.level").alias(f"_{name}"))
        )
        found = found.join(chosen, [*CLASS])
    return checkpointed(found)


def fertility_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    path: str | None = None,
    spread: float = SPREAD,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Measures and verdict of every document, one row per input row.

    Returns (``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_tokens``, ``chars_per_token``,
    ``fallback_share``, ``entropy``, ``kept``). A text of fewer than ``MIN_WORDS`` words (null and empty texts
    too) or with more than ``MAX_REPEATED`` % of its words in repeated windows fails
    the base rules and is not kept; the bands are made from those that pass, and decide on
    them. A group of fewer than ``min_group`` documents takes the bands of a wider one, and all
    documents have bands in the end, so each document is judged.
    Ids may be null or repeat. Other columns are not read. An empty table gives an empty table.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    # Tokens are made once: what follows reads the measures alone.
    rows = checkpointed(
        measured(docs, id_col, text_col, lang_col, path)
        .withColumn("base_failed", failed)
        .withColumn("_length", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    )
    passed = rows.where(~F.col("base_failed"))
    inside = F.lit(True)
    for name in LEAST_WIDTH:
        limit = F.col(f"_{name}")
        inside &= F.coalesce(F.col(name).between(limit["low"], limit["high"]), F.lit(True))
    return rows.join(bands(passed, spread, min_group), [*CLASS], "left").select(
        F.col("_id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_tokens", "chars_per_token", "fallback_share", "entropy",
        (~F.col("base_failed") & inside).alias("kept"),
    )
