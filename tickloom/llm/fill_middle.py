"""Fill-in-middle: a text is cut in three and its parts are put in another order, between sentinels.

Cuts are drawn in units (tokens of white space and what follows it, or code points) and made in bytes.  A
text's multibyte characters are its only exceptions: a sparse index holds the position of each and
how many bytes more than one it has.  Between two of them bytes and code points run alike, so a cut is converted by
one binary search among the exceptions and an addition; an ASCII text has an empty index.  All texts of a slice
share one index.

The draw depends on the seed and the id alone, so a lost task draws the same again.  Nothing is shuffled.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and one that the draw leaves alone are
``plain``.  A null id is drawn as empty text.  Rows with equal ids are drawn alike.  An empty table gives an empty one.
Extra columns are left out unless named in ``keep``.  Bytes that are no UTF-8 stay as they are; a stray one counts to the
multibyte character before it, or else as one of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.arrowtools import map_texts, utf8_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts, those that are transformed, and of a hundred of these, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class ExceptionIndex:
    """Code points and bytes of UTF-8 data, converted through its multibyte characters alone."""

    def __init__(self, data: np.ndarray) -> None:
        self.size = len(data)
        high = np.flatnonzero(data >= 0x80)
        lead = high[data[high] >= 0xC0]
        # bytes above 0x7F up to the next lead byte belong to the character (a stray one to the exception before it)
        width = np.diff(np.append(np.searchsorted(high, lead), len(high))) if len(lead) else np.zeros(0, np.int64)
        self.byte = lead
        self.excess = np.cumsum(width - 1) if len(lead) else np.zeros(0, np.int64)
        self.point = lead - np.r_[0, self.excess[:-1]] if len(lead) else lead

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte position; positions lie between characters."""
        before = np.searchsorted(self.byte, cuts, "left")
        return cuts - np.r_[0, self.excess][before]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        before = np.searchsorted(self.point, cuts, "left")
        return cuts + np.r_[0, self.excess][before]


def draws(seed: int, name: str) -> tuple[int, ...]:
    """Four numbers below 2**32 from the seed and an id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k: 4 * k + 4], "big") for k in range(4))


def token_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte ends of all tokens: blanks with what follows them, and blanks at a text's end."""
    blank = _BLANK[data]
    last = np.zeros(len(data), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    turn = np.zeros(len(data), bool)
    turn[:-1] = ~blank[:-1] & blank[1:]
    return np.flatnonzero(turn | last) + 1


def _cuts(data: np.ndarray, bounds: np.ndarray, numbers: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, byte ends of prefix and middle, and both as code points of the text."""
    index = ExceptionIndex(data)
    points = index.to_points(bounds)
    if unit == "token":
        ends = token_ends(data, bounds)
        first = np.searchsorted(ends, bounds[:-1], "right")
        n = np.searchsorted(ends, bounds[1:], "right") - first
    else:
        n = np.diff(points)
    picked = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    if unit == "token":
        at = np.r_[ends, 0][np.maximum(first[:, None] + picked - 1, 0)]
        cut = np.where(picked > 0, at, bounds[:-1, None])
    else:
        cut = index.to_bytes(points[:-1, None] + picked)
    return n, cut, index.to_points(cut) - points[:-1, None]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = SEED,
              rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "token") -> DataFrame:
    """The id, the ``keep`` columns, ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``unit`` is ``token`` or ``char``; the character counts are null for plain texts.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(slices: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for part in slices:
            data, bounds = utf8_buffers(part.column("text"))
            raw, names = data.tobytes(), part.column("k0").to_pylist()
            numbers = np.array([draws(seed, "" if x is None else str(x)) for x in names], np.int64).reshape(-1, 4)
            n, cut, chars = _cuts(data, bounds, numbers, unit)
            forms, outputs = [], []
            for a, b, (one, two), (_, _, h3, h4) in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cut.tolist(), numbers.tolist()):
                text = raw[a:b]
                if not text or h3 % 100 >= rate or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = raw[a:one], raw[one:two], raw[two:b]
                first = h4 % 100 < suffix_first
                forms.append("spm" if first else "psm")
                outputs.append(b"".join((s, suffix, p, prefix, m, middle) if first else (p, prefix, s, suffix, m, middle)))
            plain = np.array([f == "plain" for f in forms])
            yield [pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), pa.array(chars[:, 0], pa.int64(), mask=plain),
                   pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain), pa.array(outputs, pa.binary())]

    out = map_texts(docs, text_col, (id_col, *keep), "n long, form string, prefix_chars long, middle_chars long, output binary", run)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from a transformed one and its form.

    A transformed text holds each sentinel once, where two of its parts meet: no sentinel ends as another begins.
    """
    def between(start: str, stop: str | None) -> Column:
        tail = F.substring_index(output, start, -1)
        return F.substring_index(tail, stop, 1) if stop else tail

    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX)))
            .otherwise(output))
