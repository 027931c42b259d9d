"""Token ids of whole texts, by a public tokenizer whose file is a parameter.

The file is read on the driver and sent along, so executors need no copy. A tokenizer that lower-cases, drops white
space and splits letters, digits and marks by the pattern below encodes each such unit by itself. Then the units of a piece of
text are found in its bytes with numpy, each distinct one is encoded by the library once per worker, and the
ids are gathered. Texts with other characters than ASCII and Latin-1 letters, and other tokenizers, go through the library
text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import LOWER, U64, pieces, text_bytes, word_hashes

#: The normaliser and the split pattern of the tokenizers whose units are independent.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")

SPACE, LETTER, DIGIT, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[list(b"\t\n\x0b\x0c\r ")] = SPACE
KIND[list(range(ord("0"), ord("9") + 1))] = DIGIT
KIND[list(range(ord("a"), ord("z") + 1))] = LETTER
ODD = np.ones(256, bool)  # bytes that only the library reads, unless they make up a Latin-1 letter
ODD[list(range(32, 127))] = False
ODD[list(b"\t\n\x0b\x0c\r")] = False
#: Units remembered by a Python worker (some 30 bytes each); then it starts anew, which costs time only.
REMEMBERED = 2_000_000
_encoders: dict = {}


def _byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: its own where that is printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    table = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


def unit_bounds(data: np.ndarray, at: np.ndarray):
    """(lower-cased bytes, starts, ends, index of each text's first unit, whether each text is odd)."""
    data = LOWER[data]
    n = len(data)
    kind, odd = KIND[data], ODD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]  # not the signs of times and division
    high = data[lead + 1] < 0x9F
    data[lead[high] + 1] += 0x20
    kind[lead], kind[lead + 1], odd[lead], odd[lead + 1] = LETTER, LETTER, False, False
    starts = kind != SPACE
    inside = starts.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    heads = at[:-1][at[:-1] < n]
    starts[heads] = inside[heads]
    # 's and the like, where the mark begins a unit, are units of their own; what follows begins anew
    if len(marks := np.flatnonzero((data == ord("'")) & starts)):
        edge = np.append(at, n)
        room = edge[np.searchsorted(edge, marks, side="right")] - marks
        raw = data.tobytes()
        for m, r in zip(marks.tolist(), room.tolist()):
            for e in ENDINGS:
                if len(e) < r and raw.startswith(e, m + 1):
                    starts[m + 1] = False
                    if len(e) + 1 < r:
                        starts[m + 1 + len(e)] |= bool(inside[m + 1 + len(e)])
                    break
    ends = inside.copy()
    ends[:-1] &= starts[1:] | ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(starts)
    many = np.concatenate([[0], np.cumsum(odd)])
    return data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at), np.diff(many[at]) > 0


class Encoder:
    """Ids as numpy arrays of unsigned 32-bit numbers."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(content)
        spec = json.loads(content)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.independent = ((spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and len(steps) == 2
                            and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") is True
                            and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel"
                            and not steps[1].get("add_prefix_space") and spec["model"].get("dropout") is None)
        self._special = [t["content"].lower().encode() for t in spec.get("added_tokens", ())]
        self._characters = _byte_characters()
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, U64)  # sorted hashes of units; at[k], size[k]: where their ids are in flat
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes, units):
        if len(self.known) + len(hashes) > REMEMBERED:
            self._forget()
        tokenize, chars = self._library.model.tokenize, self._characters
        ids = [[t.id for t in tokenize("".join([chars[b] for b in u]))] for u in units]
        size = np.array([len(x) for x in ids], np.int64)
        at = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _units(self, data, start, end):
        """(ids, number of ids of each unit)."""
        hashes = word_hashes(data, start, end - start)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, first = ranked[new], order[new]
        place = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inner = place < len(self.known)
        missing[inner] = self.known[place[inner]] != distinct[inner]
        if missing.any():
            if len(self.known) + int(missing.sum()) > REMEMBERED:
                self._forget()
                missing[:] = True
            raw, which = data.tobytes(), first[missing]
            self._learn(distinct[missing], [raw[i:j] for i, j in zip(start[which].tolist(), end[which].tolist())])
            place = np.searchsorted(self.known, distinct)
        rank = np.empty(len(order), np.int64)
        rank[order] = place[np.cumsum(new) - 1]
        size = self.size[rank]
        skip = np.cumsum(size) - size
        return self.flat[np.repeat(self.at[rank] - skip, size) + np.arange(int(size.sum()))], size

    def encode_column(self, texts):
        """For each text of a string column, null being empty, its ids."""
        data, at = text_bytes(texts)
        if not self.independent:
            for i in range(len(at) - 1):
                yield self.whole(data[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
            return
        for i, j in pieces(at):
            raw, edge = data[at[i]:at[j]], at[i:j + 1] - at[i]
            own, start, end, first, odd = unit_bounds(raw, edge)
            if any(s in own.tobytes() for s in self._special):
                odd |= np.array([any(s in own[a:b].tobytes() for s in self._special) for a, b in zip(edge, edge[1:])])
            if odd.any():  # their units are not looked up
                doc = np.repeat(odd, np.diff(first))
                start, end = start[~doc], end[~doc]
                first = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(first)))])
            ids, size = self._units(own, start, end)
            cut = np.concatenate([[0], np.cumsum(size)])[first]
            for k in range(j - i):
                yield self.whole(raw[edge[k]:edge[k + 1]].tobytes().decode("utf-8", "replace")) if odd[k] else ids[cut[k]:cut[k + 1]]


def encoder(content: str) -> Encoder:
    """One encoder per Python worker and tokenizer."""
    if content not in _encoders:
        _encoders.clear()
        _encoders[content] = Encoder(content)
    return _encoders[content]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
