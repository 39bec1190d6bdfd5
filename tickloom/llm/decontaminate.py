"""Benchmark decontamination with a generalised suffix automaton over the test items.

The words of all items form one automaton.  Each document is streamed through it word by
word while the length of the longest match that ends there is tracked; where it reaches the
window, the last words are a passage of some item.  An item shorter than the window is
searched whole.  Only runs of words that all occur in some item can match, so only they
are streamed.

The items are a test set, not a corpus: they are read in parts of ``PART_BYTES`` of text and
each part's automaton is broadcast in its compact serial form; a task unpacks one of them at a time.

Defined results: null and empty texts have no words and are never hit; null and wordless
items occur nowhere; items with equal text are all reported; repeated rows are judged
alike; an empty benchmark hits nothing.  Null item ids are left out of the list of ids.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.arrowtools import text_slices, utf8_buffers

WINDOW = 10
#: Text of the items in one automaton.
PART_BYTES = 1 << 20
#: Fixed by the definition of a word: ASCII letters (lower-cased), digits and every byte of a non-ASCII character.
_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes(b if b in _WORD_BYTES else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class PhraseAutomaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        ends: list[tuple[int, int, str]] = []  # (state, length, item)
        self.shortest = window
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            state = 0
            for n, word in enumerate(words, 1):
                state = self._grow(state, self.codes.setdefault(word, len(self.codes)))
                if n >= window or n == len(words):
                    ends.append((state, n, name))
            self.shortest = min(self.shortest, len(words))
        # a short item whole, or the items that hold the window that a state ends with
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.holders: dict[int, set[str]] = {}
        for state, n, name in self._settled(ends):
            if n < window:
                self.whole.setdefault(state, []).append((n, name))
            else:
                self.holders.setdefault(self.window_state(state), set()).add(name)

    def _settled(self, ends: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        """A state may have been split after it was noted: climb to the one that holds the noted length."""
        for state, n, name in ends:
            while self.link[state] >= 0 and self.longest[self.link[state]] >= n:
                state = self.link[state]
            yield state, n, name

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.longest.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, source: int, code: int, target: int) -> int:
        """Give the strings of ``target`` that extend ``source`` a state of their own."""
        if self.longest[target] == self.longest[source] + 1:
            return target
        copy = self._new(self.longest[source] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.step[source].get(code) == target:
            self.step[source][code] = copy
            source = self.link[source]
        return copy

    def _grow(self, last: int, code: int) -> int:
        if code in self.step[last]:
            return self._split(last, code, self.step[last][code])
        made = self._new(self.longest[last] + 1, {}, 0)
        while last >= 0 and code not in self.step[last]:
            self.step[last][code] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, code, self.step[last][code])
        return made

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a state that is at least as long."""
        while self.longest[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, Iterable[str]]]:
        """(first word, end, items) of every occurrence of a window."""
        codes = np.fromiter(map(self.codes.get, words, iter(lambda: -1, 0)), np.int64, len(words))
        known = np.diff(np.r_[0, (codes >= 0).astype(np.int8), 0])
        starts, stops = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
        for a, b in zip(starts, stops):
            if b - a >= self.shortest:
                yield from self._stream(codes[a:b].tolist(), int(a))

    def _stream(self, codes: list[int], offset: int) -> Iterator[tuple[int, int, Iterable[str]]]:
        state, length = 0, 0
        for at, code in enumerate(codes, offset + 1):
            while state and code not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            if code in self.step[state]:
                state, length = self.step[state][code], length + 1
            if length >= self.window:
                yield at - self.window, at, self.holders[self.window_state(state)]
            if self.whole:
                up = state
                while up > 0:
                    for n, name in self.whole.get(up, ()):
                        if n <= length:
                            yield at - n, at, (name,)
                    up = self.link[up]


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
             part_bytes: int = PART_BYTES) -> list[Broadcast]:
    """Broadcast one automaton per part of the items; each part is bounded."""
    context = items.sparkSession.sparkContext
    picked = items.select(F.col(id_col).cast("string").alias("item"), F.encode(F.col(text_col), "utf-8").alias("text"))
    picked = picked.where(F.col("text").isNotNull())
    size = picked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n_parts = 1 + int(size) // part_bytes
    out = []
    for part in range(n_parts):
        rows = picked.where(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).collect()
        out.append(context.broadcast(pickle.dumps(PhraseAutomaton([(r.item, bytes(r.text)) for r in rows], window))))
    return out


@lru_cache(1)
def _loaded(pickled: bytes) -> PhraseAutomaton:
    return pickle.loads(pickled)


def _scan(texts: list[bytes], parts: list[Broadcast]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: number of words, merged hit runs of words, items found."""
    words = [words_of(t) for t in texts]
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    for part in parts:
        automaton = _loaded(part.value)
        for i, mine in enumerate(words):
            for a, b, names in automaton.matches(mine):
                hits[i].append((a, b))
                found[i].update(names)
    out = []
    for mine, spans, names in zip(words, hits, found):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        out.append((len(mine), merged, {x for x in names if x is not None}))
    return out


def _mapped(docs: DataFrame, text_col: str, keep: tuple[str, ...], parts: list[Broadcast], extra: list[T.StructField],
            row: Callable) -> DataFrame:
    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    shape = T.StructType([*[T.StructField(k, picked.schema[k].dataType) for k in names], *extra])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            data, bounds = utf8_buffers(part.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            valid = part.column("text").is_valid().to_pylist()
            made = [row(t if v else None, *x) for t, v, x in zip(texts, valid, _scan(texts, parts))]
            columns = [pa.array([m[j] for m in made], _ARROW[f.dataType.simpleString()]) for j, f in enumerate(extra)]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], *columns], names=[*names, *[f.name for f in extra]])

    out = picked.mapInArrow(run, shape)
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], *[f.name for f in extra])


def contamination(docs: DataFrame, parts: list[Broadcast], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: words, words inside a window of an item, items found and their list's digest."""

    def row(_text, n: int, runs: list, names: set) -> tuple:
        listed = ",".join(sorted(names))
        hit = sum(b - a for a, b in runs)
        return n, hit, len(names), hashlib.sha256(listed.encode()).hexdigest(), hit > 0, sorted(names)

    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
             T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
             T.StructField("items", T.ArrayType(T.StringType()))]

    return _mapped(docs, text_col, keep, parts, extra, row)


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    blank = np.frombuffer(text.translate(_FOLD), np.uint8) == 0x20
    edge = np.diff(np.r_[1, blank.astype(np.int8), 1])
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def decontaminate(docs: DataFrame, parts: list[Broadcast], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  max_coverage: float = 0.5) -> DataFrame:
    """Cut every run of hit words out of the texts; drop documents of which more than ``max_coverage`` is hit.

    Returns the ``keep`` columns and the remaining text.
    """

    def row(text: bytes | None, n: int, runs: list, _names: set) -> tuple:
        if not runs:
            return None if text is None else text.decode("utf-8", "replace"), True
        first, last = _word_bounds(text)
        kept, at = deque(), 0
        for a, b in runs:
            kept.append(text[at: first[a]])
            at = int(last[b - 1])
        kept.append(text[at:])
        return b"".join(kept).decode("utf-8", "replace"), sum(b - a for a, b in runs) <= max_coverage * n

    extra = [T.StructField("rest", T.StringType()), T.StructField("stays", T.BooleanType())]
    made = _mapped(docs, text_col, keep, parts, extra, row)
    return made.where("stays").drop("stays").withColumnRenamed("rest", text_col)
