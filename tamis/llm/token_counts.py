"""How many tokens a public tokenizer makes of each whole text.

The library encodes in Arrow functions that return lengths only; other columns stay in the JVM. Texts are cut at safe
boundaries into units, mostly words, and each distinct unit is encoded once per worker, in batches of about ``BATCH`` bytes however long or
short the texts are; a text of many megabytes is worked off in stretches of ``STRETCH`` bytes that end at such boundaries. A boundary lies
where a character other than white space is followed by an ASCII space or line break. A byte-level tokenizer with the usual
pattern, without normaliser, prefix space and added tokens that hold or touch white space, never has a token across such a place, nor
looks beyond it: no part of its pattern has white space after another character, and its one look-ahead starts from white space.
A text without such a place is one unit, however long. Other tokenizers get whole texts, in batches of the same size.

Defined results: null is empty, which has no tokens; strings of special tokens inside a text are read as the library does by default;
repeated rows are counted each; an empty table gives no rows; other columns are kept, and one named like the result is replaced.
Units are told apart by a 64-bit hash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, pieces, text_bytes, word_hashes

STRETCH = BATCH = 1 << 20
#: Units remembered by a Python worker (16 bytes each); then it starts anew, which costs time only.
REMEMBERED = 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \n")] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True
#: First bytes of two- and three-byte characters among which there is no white space.
_TWO, _THREE = np.zeros(256, bool), np.zeros(256, bool)
_TWO[0xC3:0xE0] = True
_THREE[[0xE0, *range(0xE4, 0xF0)]] = True
_counters: dict = {}


def splits_at_spaces(spec: dict) -> bool:
    """Whether the tokens of a text, by its tokenizer's description, are those of its pieces."""
    step = spec.get("pre_tokenizer") or {}
    return (step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space", True)
            and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
            and spec["model"].get("type") == "BPE" and spec["model"].get("dropout") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", ())))


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places in a text's bytes before which it may be cut."""
    other = _PRINTED[data]
    high = data >= 0x80
    other[1:] |= high[1:] & _TWO[data[:-1]]
    other[2:] |= high[2:] & _THREE[data[:-2]]
    return np.flatnonzero(_SPACE[data[1:]] & other[:-1]) + 1


def stretches(data: np.ndarray, at: np.ndarray, size: int = STRETCH):
    """(index of the first text, bytes, bounds of texts within): whole texts, or the next part of a long one."""
    for i, j in pieces(at, size):
        if at[j] - at[i] <= 2 * size:
            yield i, data[at[i]:at[j]], at[i:j + 1] - at[i]
            continue
        begin, end = int(at[i]), int(at[j])
        while begin < end:
            cut, seen = end, begin + size
            while seen < end:
                found = safe_places(data[max(seen - 3, begin):min(seen + size, end)])
                found = found[found >= 3]
                if len(found):
                    cut = max(seen - 3, begin) + int(found[0])
                    break
                seen += size
            yield i, data[begin:cut], np.array([0, cut - begin])
            begin = cut


class Counter:
    """Token counts of string columns by the library of a tokenizer file."""

    def __init__(self, content: bytes, stretch: int = STRETCH, batch: int = BATCH):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        self.stretch, self.batch = stretch, batch
        if content[:1] == b"{":
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(content.decode())
            library.no_truncation()
            library.no_padding()
            self.split = splits_at_spaces(json.loads(content))
            self._lengths = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=content)
            self.split = False
            self._lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        self.known, self.sizes = np.zeros(0, U64), np.zeros(0, np.int64)

    def _encoded(self, data, start, end) -> np.ndarray:
        """Tokens of byte ranges, by the library, in batches of about the same number of bytes."""
        raw, sizes = data.tobytes(), []
        for i, j in pieces(np.concatenate([[0], np.cumsum(end - start)]), self.batch):
            sizes += self._lengths([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[i:j].tolist(), end[i:j].tolist())])
        return np.array(sizes, np.int64)

    def _units(self, data, start, end) -> np.ndarray:
        distinct, first, rank = np.unique(word_hashes(data, start, end - start), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inner = place < len(self.known)
        missing[inner] = self.known[place[inner]] != distinct[inner]
        if missing.any():
            if len(self.known) + int(missing.sum()) > REMEMBERED:
                self.known, self.sizes = self.known[:0], self.sizes[:0]
                place[:], missing[:] = 0, True
            sizes = self._encoded(data, start[first[missing]], end[first[missing]])
            self.known = np.insert(self.known, place[missing], distinct[missing])
            self.sizes = np.insert(self.sizes, place[missing], sizes)
            place = np.searchsorted(self.known, distinct)
        return self.sizes[place][rank]

    def count(self, texts) -> np.ndarray:
        data, at = text_bytes(texts)
        counts = np.zeros(len(texts), np.int64)
        if not self.split:
            some = np.flatnonzero(np.diff(at))
            counts[some] = self._encoded(data, at[some], at[some + 1])
            return counts
        for i, own, edge in stretches(data, at, self.stretch):
            start = np.union1d(safe_places(own), edge[:-1][edge[:-1] < edge[1:]])
            if not len(start):
                continue
            sizes = self._units(own, start, np.append(start[1:], len(own)))
            texts_of = np.searchsorted(edge, start, side="right") - 1
            counts[i:i + len(edge) - 1] += np.bincount(texts_of, sizes, len(edge) - 1).astype(np.int64)
        return counts


def counter(content: bytes) -> Counter:
    """One counter per Python worker and tokenizer."""
    if content not in _counters:
        _counters.clear()
        _counters[content] = Counter(content)
    return _counters[content]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """All rows and columns of ``docs`` and a long column ``name``. ``tokenizer`` is the path of a .json or .model file."""
    with open(tokenizer, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary

    @F.arrow_udf("long")
    def tokens(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(content.value).count
        for column in columns:
            yield pa.array(count(column), pa.int64())

    return docs.withColumn(name, tokens(F.col(text).cast("string")))
