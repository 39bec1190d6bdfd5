"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1- to 3-grams of the lower-cased text, in which every run boundary of
non-letters is one blank, are hashed to ``BUCKETS`` cells.  Training sums the cells of each
language inside tasks and across them; the matrix of log probabilities (cells x languages,
a fixed size) is broadcast, and texts are scored in batches with numpy.  All languages are taken for equally frequent.

Defined results: a null text, an empty text and a text without a letter get ``und`` and
score 0.  Ties go to the language that sorts first.  Repeated rows are scored alike.  A
language label that is null is never learned.  Without any training row every text is
``und``.  Very long texts are read in pieces, whole; an n-gram over a seam counts once.  Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.llm.arrowtools import text_slices

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Bound of the training sample, in documents per language; languages with fewer are learned whole.
TRAIN_DOCS = 16_384
#: Characters of one text handled at once.
PIECE = 1 << 19
_CHUNKS = 32
_BLANK = 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], str, bool]]:
    """Join short texts, cut long ones; the flag tells that a piece goes on where the last one ended."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > PIECE:
            at = 0
            while at < len(text):
                # at a blank if one is near: lower-casing may look at the next letter
                stop = max(text.rfind(" ", at + PIECE - 1000, at + PIECE), at) or at
                stop = stop if stop > at and at + PIECE < len(text) else at + PIECE
                yield [i], text[at:stop], at > 0
                at = stop
            continue
        rows.append(i)
        parts.append(text.replace("\0", " "))
        size += len(text)
        if size > PIECE:
            yield rows, "\0".join(parts), False
            rows, parts, size = [], [], 0
    if rows:
        yield rows, "\0".join(parts), False


def gram_cells(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, cell) of every n-gram, piece by piece; n-grams of blanks alone are left out."""
    letters, tail = _letters(), np.zeros(0, np.uint64)
    for rows, joined, goes_on in _pieces(texts):
        raw = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(rows) == 1:
            owner = np.full(len(raw), rows[0], np.int32)
        else:
            owner = np.asarray(rows, np.int32)[np.minimum(np.cumsum(raw == 0), len(rows) - 1)]
        # the last two characters before a seam go along, and n-grams that end among them are known already
        old = tail if goes_on else tail[:0]
        letter = letters[raw]
        code = np.r_[old, np.where(letter, raw, _BLANK).astype(np.uint64)]
        letter, owner = np.r_[old != _BLANK, letter], np.r_[np.full(len(old), rows[0], np.int32), owner]
        blank = ~letter
        keep = np.ones(len(code), bool)
        keep[1:] = letter[1:] | letter[:-1]  # runs of non-letters become one blank
        code, blank, owner = code[keep], blank[keep], owner[keep]
        tail = code[-2:]
        if not len(code):
            continue
        mixed = code * _ODD[0]
        for n in (1, 2, 3):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = mixed[:m].copy()
            for k in range(1, n):
                h = (h ^ (h >> np.uint64(29))) * _ODD[k] + mixed[k: k + m]
            h = (h ^ (h >> np.uint64(32))) * _ODD[n - 1]
            # inside one text, and at least one letter
            ok = owner[:m] == owner[n - 1:]
            ok[: max(0, len(old) - n + 1)] = False
            if n == 1:
                ok &= ~blank[:m]
            elif n == 2:
                ok &= ~(blank[:m] & blank[1:])
            yield owner[:m][ok], (h[ok] >> np.uint64(48)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_key: tuple[str, ...] = ("doc_id",),
          docs_per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Return the learned languages and the (BUCKETS, languages) matrix of log probabilities.

    At most about ``docs_per_language`` documents of a language are read, chosen by a
    hash of the text and ``sample_key``; the matrix is all that reaches the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # one number per language: the text itself is drawn where it is read, without a shuffle
    totals = {r.lang: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not totals:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, docs_per_language / n))]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.col(text_col), *[F.col(c) for c in sample_key]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in text_slices(batches, "text"):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            found = np.zeros(len(names) * BUCKETS, np.int64)
            for owner, cell in gram_cells(part.column("text").to_pylist()):
                found += np.bincount(number[owner] * BUCKETS + cell, minlength=len(found))
            for k, name in enumerate(names):
                mine = found[k * BUCKETS: (k + 1) * BUCKETS]
                sums[name] = sums[name] + mine if name in sums else mine.copy()
        width = BUCKETS // _CHUNKS
        for name, cells in sums.items():
            yield pa.RecordBatch.from_pydict({
                "lang": [name] * _CHUNKS, "chunk": pa.array(range(_CHUNKS), pa.int32()),
                "cells": [cells[k * width: (k + 1) * width].tobytes() for k in range(_CHUNKS)],
            })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in batches:
            for row in batch.column("cells"):
                cells = np.frombuffer(row.as_buffer(), np.int64)
                total = cells + (0 if total is None else total)
            key = batch.column("lang")[0].as_py(), batch.column("chunk")[0].as_py()
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "lang": [key[0]], "chunk": pa.array([key[1]], pa.int32()), "cells": [total.tobytes()]})

    shape = "lang string, chunk int, cells binary"
    rows = sample.mapInArrow(count, shape).groupBy("lang", "chunk").applyInArrow(add, shape).collect()
    names = sorted({r.lang for r in rows})
    counts = np.zeros((BUCKETS, len(names)))
    width = BUCKETS // _CHUNKS
    for r in rows:
        counts[r.chunk * width: (r.chunk + 1) * width, names.index(r.lang)] = np.frombuffer(r.cells, np.int64)
    smooth = counts + 0.5
    return names, np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Return the ``keep`` columns with ``lang_pred`` and ``score``, the predicted language's posterior."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    names_in = ["text" if c == text_col else f"k{i}" for i, c in enumerate(keep)]  # the text travels once
    picked = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names_in) if k != "text"], F.col(text_col).alias("text"))
    fields = [T.StructField(k, picked.schema[k].dataType) for k in names_in]
    shape = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.T)
        for part in text_slices(batches, "text"):
            n = part.num_rows
            sums, grams = np.zeros((n, max(1, len(names)))), np.zeros(n, np.int64)
            for owner, cell in gram_cells(part.column("text").to_pylist()):
                if not len(owner):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                grams[owner[starts]] += np.diff(np.r_[starts, len(owner)])
                for k in range(len(names)):
                    sums[owner[starts], k] += np.add.reduceat(table[k][cell], starts, dtype=np.float64)
            best = sums.argmax(axis=1)
            top = sums[np.arange(n), best]
            posterior = 1.0 / np.exp(np.minimum(sums - top[:, None], 0)).sum(axis=1)
            known = (grams > 0) & bool(names)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in names_in],
                 pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, known)], pa.string()),
                 pa.array(np.where(known, posterior, 0.0))],
                names=[*names_in, "lang_pred", "score"])

    out = picked.mapInArrow(score, shape)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names_in)], "lang_pred", "score")


def accepted(min_score: float = 0.5) -> Column:
    """Documents whose language is known with at least ``min_score``."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
