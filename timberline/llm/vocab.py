"""Public vocabularies, applied word by word with a cache of bounded size.

None of the supported vocabularies has a token across white space, so the ids
of a text are the ids of its words one after the other. A worker keeps the ids
of the words it met lately, in two generations: when the younger is full it becomes the
older one, and what was not used since goes. A word that is met again is encoded
again, so the size of the cache costs time only.

:meth:`Vocabulary.ids` does the same for whole Arrow arrays: words are told by 64-bit hashes of their
bytes, and their ids are gathered with numpy; Python handles only words that are not in the cache.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from timberline.llm.words import LOWER, SpanHasher, text_bytes, word_spans

CACHE_WORDS = 120_000  # of a generation
CACHE_IDS = 1_000_000  # words, or letters of words, known by hash; about 40 bytes each
_TOGETHER = 1000  # plain words encoded in one call

_LOADED: dict[str, "Vocabulary"] = {}

# Letters whose lower case is one letter and that do not combine, and ASCII signs without the apostrophe.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-þ]+")
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SIGN, _LETTER, _LATIN, _CAPITAL = np.zeros((4, 256), bool)
_SIGN[list(_SIGNS)] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Second bytes, after 0xC3, of the letters À to þ, and of the capitals among them.
_LATIN[[b for b in range(0x80, 0xBF) if b not in (0x97, 0xB7)]] = True
_CAPITAL[[b for b in range(0x80, 0x9F) if b != 0x97]] = True


class _Generations:
    """A dictionary that forgets what was not used for a generation."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def table(self, words) -> tuple[dict, list]:
        """The younger generation with all known ones of ``words``, and the unknown ones."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for word in words:
            if word not in young:
                found = old.get(word)
                if found is None:
                    new.append(word)
                else:
                    young[word] = found
        return young, new


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all given ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)


class _IdTable:
    """Ids by 64-bit key in sorted arrays. When it is full, what was not used since it was last full goes."""

    def __init__(self, size: int, dtype: np.dtype):
        self.size = size
        self.keys, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used, self.ids = np.empty(0, bool), np.empty(0, dtype)

    def rows(self, keys: np.ndarray, encode) -> np.ndarray:
        """The row of every one of distinct ``keys``; ``encode`` gives the ids, as bytes, of those at some places of ``keys``."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.used[at[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > self.size:
                self._forget()
            new = new[np.argsort(keys[new])]
            self._add(keys[new], encode(new))
            at = np.searchsorted(self.keys, keys)
        return at

    def _forget(self) -> None:
        kept = np.flatnonzero(self.used)
        self.ids = self.ids[_ranges(self.start[kept], self.count[kept])]
        self.keys, self.count = self.keys[kept], self.count[kept]
        self.start, self.used = np.cumsum(self.count) - self.count, np.zeros(len(kept), bool)

    def _add(self, keys: np.ndarray, found: list[bytes]) -> None:
        count = np.fromiter(map(len, found), np.int64, len(found)) // self.ids.dtype.itemsize
        at = np.searchsorted(self.keys, keys)
        self.keys, self.count = np.insert(self.keys, at, keys), np.insert(self.count, at, count)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(count) - count)
        self.used = np.insert(self.used, at, True)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.ids.dtype)])


class Vocabulary:
    """Ids of words by one vocabulary file, kept as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        self.special = np.empty(0, np.int64)
        self._in_parts = False
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(path)
            self._many = getattr(self._model, "encode_batch_fast", self._model.encode_batch)
            self.size = self._model.get_vocab_size()
            self._ends = np.zeros(self.size, bool)
            self._ends[[i for token, i in self._model.get_vocab().items() if token.endswith("</w>")]] = True
            self._encode = self._encode_each
            self._in_parts = bool(self._ends.any())
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            model = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self._encode = lambda words: [self._bytes(model.encode_ordinary(w.decode())) for w in words]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.get_piece_size()
            self.special = np.flatnonzero([model.is_byte(i) for i in range(self.size)])
            self._encode = lambda words: [self._bytes(ids) for ids in model.encode([w.decode() for w in words], num_threads=1)]
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._words = _Generations(CACHE_WORDS)
        self._table = _IdTable(CACHE_IDS, self.dtype)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _encode_each(self, words: list[bytes]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self._many([w.decode() for w in words], add_special_tokens=False)]

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Letters alone, folded, end with the one token that closes a word, so many of them are encoded as one text."""
        plain = [part.isalpha() or bool(_LETTERS.fullmatch(part.decode())) for part in parts]
        letters = [part for part, is_plain in zip(parts, plain) if is_plain]
        found = []
        for start in range(0, len(letters), _TOGETHER):
            found += self._encode_letters(letters[start : start + _TOGETHER])
        known, odd = iter(found), iter(self._encode_each([part for part, is_plain in zip(parts, plain) if not is_plain]))
        return [next(known) if is_plain else next(odd) for is_plain in plain]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self._many([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._encode_each(words)
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """For a vocabulary that folds case and parts letters from signs: the folded bytes, and the spans of the
        letters and of the signs behind them. A word of any other kind stays whole and unfolded."""
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        behind = np.maximum.accumulate(np.where(_SIGN[data], 0, np.arange(1, len(data) + 1)))
        cut = np.maximum(starts, behind[ends - 1])
        strange = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~(_LETTER[data] | (data == 0xC3) | (after & _LATIN[data])), out=strange[1:])
        odd = np.flatnonzero((cut == starts) | (strange[cut] > strange[starts]))
        cut[odd] = ends[odd]
        folded = LOWER[data]
        folded[after & _CAPITAL[data]] += 32
        whole = _ranges(starts[odd], ends[odd] - starts[odd])
        folded[whole] = data[whole]
        starts, ends = np.stack([starts, cut], 1).ravel(), np.stack([cut, ends], 1).ravel()
        filled = starts < ends
        return folded, starts[filled], ends[filled]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins; null counts as empty."""
        data, offsets = text_bytes(texts)
        starts, ends = word_spans(data, offsets)
        if not len(starts):
            return np.empty(0, self.dtype), np.zeros(len(offsets), np.int64)
        if self._in_parts:
            data, starts, ends = self._parts(data, starts, ends)
        codes, keys = pd.factorize(SpanHasher(data)(starts, ends))
        one = np.empty(len(keys), np.int64)
        one[codes] = np.arange(len(codes))
        raw, encode = data.tobytes(), self._encode_parts if self._in_parts else self._encode

        def encoded(places: np.ndarray) -> list[bytes]:
            some = one[places]
            return encode([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])

        rows = self._table.rows(keys, encoded)[codes]
        count = self._table.count[rows]
        total = np.append(0, np.cumsum(count))
        return self._table.ids[_ranges(self._table.start[rows], count)], total[np.searchsorted(starts, offsets)]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table with the ids of at least the given words."""
        table, new = self._words.table(words)
        if new:
            table.update(zip(new, self._encode(new)))
        return table


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def forget() -> None:
    """Give back the memory of loaded vocabularies; later steps in the same worker need it."""
    _LOADED.clear()


def public_path(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
