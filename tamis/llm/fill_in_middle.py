"""Fill-in-the-middle: texts cut at line ends, their parts put in another order behind marks, and back again.

A worker lays the texts of a batch end to end. The line ends give the cuts. Each byte's way to its place in the output is its shift, and
the shift changes at a text's start and its two cuts only: those changes are written into a difference array, its running sum is
every byte's shift, and one scatter puts all bytes of a stretch in place. The way back finds the marks in the output, builds the
shifts of the restored text alike, and gathers. Stretches are ``STRETCH`` bytes, so one very long text needs a few times
its own size. The random numbers come from a hash of the document's id, so a repeated task cuts alike.

Defined results: null is an empty text; an empty text, one that holds a mark already, and one not drawn are plain: they stay as they are; a
missing id draws as the empty string; repeated rows are cut alike; an empty table gives no rows; other columns are kept, and one named like
the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces, text_bytes

#: The marks, and the forms by number.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = range(3)
FORMS = ("plain", "psm", "spm")
MARK = len(PREFIX)
STRETCH, BATCH = 1 << 20, 1 << 22
RESULT = "struct<output:string,form:string,n_lines:long,prefix_chars:long,middle_chars:long>"


def shifts(size: int, places, values):
    """(first, end, shift of each byte between) over ``size`` bytes: the shift is values[k] from places[k] (ascending) on."""
    change, now = np.diff(values, prepend=0), 0
    for a in range(0, size, STRETCH):
        b = min(a + STRETCH, size)
        i, j = np.searchsorted(places, (a, b))
        steps = np.zeros(b - a, np.int64)
        np.add.at(steps, places[i:j] - a, change[i:j])
        steps[0] += now
        steps = np.cumsum(steps)
        now = int(steps[-1])
        yield a, b, steps


def find_marks(data: np.ndarray, at: np.ndarray):
    """(places of marks, the text each lies in, the mark's letter)."""
    place = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) >= MARK else np.zeros(0, np.int64)
    letter = data[place + 1]
    named = np.isin(letter, [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])
    place, letter = place[named], letter[named]
    text = np.searchsorted(at, place, side="right") - 1
    inside = place + MARK <= at[text + 1]
    return place[inside], text[inside], letter[inside]


def line_cuts(data, at, first_draw, second_draw):
    """(lines of each text, end of the prefix, end of the middle), as places in the batch."""
    breaks = np.flatnonzero(data == 10)
    start, end = at[:-1], at[1:]
    before = np.searchsorted(breaks, at)
    n = np.diff(before)
    last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(n), np.uint8)
    whole = n.copy()
    n = n + ((end > start) & (last != 10))

    def after(k):
        broken = (k > 0) & (k <= whole)
        out = np.where(k > 0, end, start)
        out[broken] = breaks[(before[:-1] + k - 1)[broken]] + 1
        return out

    a, b = first_draw % (n + 1), second_draw % (n + 1)
    return n, after(np.minimum(a, b)), after(np.maximum(a, b))


def parts_at(form, o, prefix, middle, suffix):
    """Where prefix, middle and suffix begin in outputs that begin at ``o``, from their lengths."""
    p = np.select([form == PSM, form == SPM], [o + MARK, o + 2 * MARK + suffix], o)
    m = np.where(form == PLAIN, o + prefix, o + 3 * MARK + prefix + suffix)
    s = np.select([form == PSM, form == SPM], [o + 2 * MARK + prefix, o + MARK], o + prefix + middle)
    return p, m, s


def scatter(data, at, a, b, form):
    """(bytes, bounds) of the outputs of texts with cuts ``a`` and ``b``."""
    start, end = at[:-1], at[1:]
    sizes = end - start + np.where(form == PLAIN, 0, 3 * MARK)
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    p, m, s = parts_at(form, out_at[:-1], a - start, b - a, end - b)
    out = np.empty(int(out_at[-1]), np.uint8)
    places, values = np.stack([start, a, b], 1).ravel(), np.stack([p - start, m - a, s - b], 1).ravel()
    for lo, hi, shift in shifts(len(data), places, values):
        shift += np.arange(lo, hi)
        out[shift] = data[lo:hi]
    cut = form != PLAIN
    for mark, place in ((PREFIX, p), (MIDDLE, m), (SUFFIX, s)):
        for k in range(MARK):
            out[place[cut] - MARK + k] = mark[k]
    return out, out_at


def gather(data, at, form):
    """(bytes, bounds) of the texts that gave these outputs."""
    cut = np.flatnonzero(form != PLAIN)
    place, text, letter = find_marks(data, at)
    own = form[text] != PLAIN
    place, text, letter = place[own], text[own], letter[own]
    order = {PSM: PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], SPM: SUFFIX[1:2] + PREFIX[1:2] + MIDDLE[1:2]}
    if len(place) != 3 * len(cut) or (text != np.repeat(cut, 3)).any() or letter.tobytes() != b"".join(order[f] for f in form[cut].tolist()):
        raise ValueError("an output does not have the marks of its form")
    place = place.reshape(-1, 3)
    start, end = at[:-1], at[1:]
    p, m, s = start.copy(), end.copy(), end.copy()  # where the parts begin in a plain output
    prefix, middle, suffix = end - start, np.zeros_like(start), np.zeros_like(start)
    psm = form[cut] == PSM
    first, second, third = place.T + MARK
    first_size, second_size = second - MARK - first, third - MARK - second
    p[cut], s[cut], m[cut] = np.where(psm, first, second), np.where(psm, second, first), third
    prefix[cut], suffix[cut] = np.where(psm, first_size, second_size), np.where(psm, second_size, first_size)
    middle[cut] = end[cut] - third
    back_at = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    a = back_at[:-1] + prefix
    b = a + middle
    out = np.empty(int(back_at[-1]), np.uint8)
    places, values = np.stack([back_at[:-1], a, b], 1).ravel(), np.stack([p - back_at[:-1], m - a, s - b], 1).ravel()
    for lo, hi, shift in shifts(len(out), places, values):
        shift += np.arange(lo, hi)
        out[lo:hi] = data[shift]
    return out, back_at


def _strings(data, at) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _cut_batch(texts, draws, rate, spm) -> pa.Array:
    data, at = text_bytes(texts)
    h1, h2, h3, h4 = (d.to_numpy(zero_copy_only=False) for d in draws)
    n, a, b = line_cuts(data, at, h1, h2)
    marked = np.zeros(len(n), bool)
    marked[find_marks(data, at)[1]] = True
    plain = (at[1:] == at[:-1]) | marked | (h3 % 100 >= rate)
    form = np.where(plain, PLAIN, np.where(h4 % 100 < spm, SPM, PSM))
    head = (data & 0xC0) != 0x80  # the first byte of a character

    def chars(begin, end):
        counts = [int(np.count_nonzero(head[i:j])) for i, j in zip(begin.tolist(), end.tolist())]
        return pa.array(counts, pa.int64(), mask=plain)

    return pa.StructArray.from_arrays(
        [_strings(*scatter(data, at, a, b, form)), pa.array(np.array(FORMS, object)[form], pa.string()), pa.array(n, pa.int64()),
         chars(at[:-1], a), chars(a, b)], ["output", "form", "n_lines", "prefix_chars", "middle_chars"])


def _runs(texts):
    """(first, end) of rows of about ``BATCH`` bytes together."""
    return pieces(text_bytes(texts)[1], BATCH)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from the SHA-256 of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text", name: str = "fim") -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``name``: output, form (plain, psm, spm), n_lines, prefix_chars and middle_chars (null
    if plain). ``rate`` per cent of the texts are drawn, ``spm`` per cent of those have the suffix first."""

    @F.arrow_udf(RESULT)
    def cut(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *numbers in columns:
            if not len(texts):
                yield pa.array([], pa.struct([("output", pa.string()), ("form", pa.string()), *((c, pa.int64()) for c in ("n_lines", "prefix_chars", "middle_chars"))]))
            for i, j in _runs(texts):
                yield _cut_batch(texts.slice(i, j - i), [x.slice(i, j - i) for x in numbers], rate, spm)

    return docs.withColumn(name, cut(F.col(text).cast("string"), *draws(F.col(doc_id), seed)))


def restore(docs: DataFrame, output: str | Column = "fim.output", form: str | Column = "fim.form", name: str = "restored") -> DataFrame:
    """All rows and columns of ``docs`` and the exact texts that gave the outputs. Fails on an output without the marks of its form."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c

    @F.arrow_udf("string")
    def back(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for outputs, forms in columns:
            if not len(outputs):
                yield pa.array([], pa.string())
            for i, j in _runs(outputs):
                data, at = text_bytes(outputs.slice(i, j - i))
                form = np.array([FORMS.index(f or FORMS[PLAIN]) for f in forms.slice(i, j - i).to_pylist()], np.int64)
                yield _strings(*gather(data, at, form))

    return docs.withColumn(name, back(as_column(output), as_column(form)))
