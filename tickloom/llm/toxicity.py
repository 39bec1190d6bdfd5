"""Toxicity scores of texts restored by a noisy channel.

Writers hide words by look-alike characters (``1d10t``), spacing (``i d i o t``) and repetition
(``idiooot``).  A chunk with such signs becomes a lattice: each character may stand for
itself or for the letters it resembles, repeated characters may be dropped, and the best path
under a character language model (Viterbi) is the restored word.  A chunk without such signs
has a single path, itself, so it is not decoded.

The language model is counted over the whole corpus: 4-grams of a 28-letter alphabet, a table of
fixed size.  The score is a logistic model of the words and word beginnings of the restored
text, fitted on at most ``TRAIN_DOCS`` labelled documents: features are counted in tasks,
the most telling ``FEATURES`` of them are kept, and their weights are fitted on the driver from the kept
features of the sample.

Defined results: a null or empty text gets the score of a text without any telling feature.
Documents with contradictory labels count as toxic; null labels are ignored.  Without both
classes in the sample every score is the base rate (0 without labels).  Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.arrowtools import text_slices, utf8_buffers
from tickloom.session import materialise

#: Bound of the fitting sample, in documents.
TRAIN_DOCS = 20_000
FEATURES = 4096
BUCKETS = 1 << 20
CACHE = 300_000
#: Fixed channel: characters that stand for letters, and the log-probability of such a disguise and of a repetition.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
         "€": "e", "(": "c"}
DISGUISE, REPEAT, LITERAL = -1.0, -1.0, -6.0

_SIZE = 28
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_EDGE = " \t\r\n.,;:?\"'()[]{}<>#%&*=~^/\\_-"
_SIGN = re.compile(r"[a-z][0-9@$!|+€(]|[0-9@$!|+€(][a-z]|([a-z])\1\1")
_GAP = r"[ .\-_*]"
_SPACED = re.compile(rf"(?<!\S)[a-z0-9@$!|+€]({_GAP}{{1,3}})(?:[a-z0-9@$!|+€]\1){{1,}}[a-z0-9@$!|+€](?![^\s.,;:?])")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_ADDRESS = re.compile(r"://|^www\.|[^@]@[a-z0-9-]+\.")
_NUMBER = re.compile(r"[$€+(@!|]*[0-9][0-9.,:/\-]*[$€+!|]*")
_LOOKS = re.compile(r"[0-9@$!|+€(]{3,}")


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a letter after three others, from all texts: 28**4 numbers."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE ** 4, np.int64)
        for part in text_slices(batches, "text", 1 << 20):
            code = _CODE[utf8_buffers(part.column("text"))[0]]
            if len(code) > 3:
                four = ((code[:-3] * _SIZE + code[1:-2]) * _SIZE + code[2:-1]) * _SIZE + code[3:]
                total += np.bincount(four, minlength=len(total))
        at = np.flatnonzero(total)
        width = _SIZE ** 3
        for k in range(_SIZE):
            mine = at[(at >= k * width) & (at < (k + 1) * width)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "at": [mine.astype(np.int32).tobytes()],
                                              "n": [total[mine].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(_SIZE ** 4, np.int64), None
        for batch in batches:
            key = batch.column("chunk")[0].as_py()
            for at, n in zip(batch.column("at"), batch.column("n")):
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key], pa.int32()), "at": [at.astype(np.int32).tobytes()],
                                          "n": [total[at].tobytes()]})

    shape = "chunk int, at binary, n binary"
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, shape).groupBy("chunk").applyInArrow(add, shape).collect()
    four = np.zeros(_SIZE ** 4)
    for r in rows:
        four[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.n, np.int64)
    four = four.reshape((_SIZE,) * 4)
    # each order leans on the next shorter one
    model = np.full(_SIZE, 1.0 / _SIZE)
    for counts in (four.sum((0, 1, 2)), four.sum((0, 1)), four.sum(0), four):
        model = (counts + 5.0 * model) / (counts.sum(-1, keepdims=True) + 5.0)
    return np.log(model).astype(np.float32)


class Decoder:
    """Viterbi search over the character lattice of a chunk."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model

    def restore(self, chunk: str) -> str:
        """The most probable word behind a chunk, without its edge punctuation."""
        word = chunk.strip(_EDGE)
        # states: the last three letters; a state keeps its best score and path
        states: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
        before = ""
        for c in word:
            steps: dict[tuple[int, int, int], tuple[float, str]] = {}
            options = [(x, DISGUISE) for x in LOOKS.get(c, "")]
            if c.isalpha():
                options.append((c, 0.0))
            for state, (score, path) in states.items():
                if c == before or not options:  # a repeated character, or one that carries no letter
                    _better(steps, state, score + (REPEAT if c == before else LITERAL), path)
                for x, cost in options:
                    k = ord(x) - 96 if "a" <= x <= "z" else 27
                    gain = float(self.model[state[0], state[1], state[2], k])
                    _better(steps, (state[1], state[2], k), score + cost + gain, path + x)
            states, before = steps, c
        best = max(((s + float(self.model[k[0], k[1], k[2], 0]), p) for k, (s, p) in states.items()), default=(0.0, ""))
        return best[1]


def _better(steps: dict, state: tuple[int, int, int], score: float, path: str) -> None:
    if state not in steps or steps[state][0] < score:
        steps[state] = score, path


def short(chunk: str) -> str:
    """The chunk with at most three of a repeated character; more of them say nothing more."""
    return _RUN.sub(r"\1\1\1", chunk)


def disguised(chunk: str) -> bool:
    """Does a lower-cased chunk carry a sign of disguise?  Numbers, addresses and keys do not.

    A key has over 40 characters besides repetitions, or six digits with one among them that resembles no letter.
    A chunk of look-alikes only is a disguise unless it is written as a number is.
    """
    chunk = short(chunk)
    if len(chunk) > 40 or _ADDRESS.search(chunk):
        return False
    if _SIGN.search(chunk):
        return sum(c in "0123456789" for c in chunk) < 6 or not ("2" in chunk or "6" in chunk)
    word = chunk.strip(_EDGE)
    return bool(_LOOKS.fullmatch(word)) and len(set(word)) > 1 and not _NUMBER.fullmatch(word)


class Words:
    """The restored words of texts; decoded chunks are cached up to a bound."""

    def __init__(self, model: np.ndarray) -> None:
        self.decoder = Decoder(model)
        self.seen: dict[str, str] = {}

    def word(self, chunk: str) -> str:
        found = self.seen.get(chunk)
        if found is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            found = self.seen[chunk] = self.decoder.restore(short(chunk)) if disguised(chunk) else chunk.strip(_EDGE + "!$@|+")
        return found

    def _joined(self, spaced: str) -> str:
        """The word behind letters with gaps; three digits are no word."""
        word = re.sub(_GAP, "", spaced)
        return spaced if len(word) < 4 and word.isdigit() else self.decoder.restore(short(word))

    def spaced(self, text: str) -> list[str]:
        """Words written with a separator after each letter, restored."""
        return [self._joined(m.group()) for m in _SPACED.finditer(text)]

    def restored(self, text: str) -> str:
        """The whole text, lower-cased, with its disguised chunks restored."""
        joined = _SPACED.sub(lambda m: self._joined(m.group()), text.lower())
        return " ".join(self.word(c) if disguised(c) else c for c in joined.split())


def _buckets(word: str) -> list[int]:
    """Hashed features of a word: the word and its beginnings."""
    if not word:
        return []
    out = [crc32(f"w{word}".encode("utf-8", "replace")) % BUCKETS]
    return out + [crc32(f"p{word[:n]}".encode("utf-8", "replace")) % BUCKETS for n in (3, 4, 5) if len(word) > n]


class Features:
    """Hashed features of the restored text, optionally only the chosen ones (as their numbers)."""

    def __init__(self, model: np.ndarray, chosen: dict[int, int] | None = None) -> None:
        self.words, self.chosen = Words(model), chosen
        self.seen: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = _buckets(word)
        return tuple(found) if self.chosen is None else tuple(self.chosen[b] for b in found if b in self.chosen)

    def of(self, text: str | None) -> set[int]:
        low = (text or "").lower()
        out: set[int] = set()
        seen = self.seen
        for chunk in set(low.split()):
            found = seen.get(chunk)
            if found is None:
                if len(seen) >= CACHE:
                    seen.clear()
                found = seen[chunk] = self._of(self.words.word(chunk))
            if found:
                out.update(found)
        for word in self.words.spaced(low):
            out.update(self._of(word))
        return out


def _fit(rows: list[tuple[list[int], int]], width: int, rounds: int = 2000, decay: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary features by accelerated gradient steps from zero, with an L2 term."""
    index = np.concatenate([np.asarray(f, np.int64) for f, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    y = np.array([t for _, t in rows], float)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, w[index], minlength=len(rows)) + w[-1]

    def backward(x: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(index, x[owner], minlength=width), x.sum()]

    # the steepest curvature, by power iteration, bounds the step
    steep = np.ones(width + 1)
    for _ in range(30):
        steep = backward(forward(steep / np.linalg.norm(steep)))
    rate = 1 / (0.25 * 1.1 * np.linalg.norm(steep) + decay)
    w = np.zeros(width + 1)
    look = w.copy()
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(look), -30, 30)))
        slope = backward(p - y)
        slope[:-1] += decay * look[:-1]
        new = look - rate * slope
        look, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> tuple[dict[int, int], np.ndarray, float]:
    """Fit on a bounded sample of the labelled documents: the kept features, their weights and the bias."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("y"))
    n_known = known.count()
    share = min(1.0, train_docs / max(1, n_known))
    # at most about train_docs pairs of numbers: small enough to send to every task
    sample = known.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    mine = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "y"))
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(shared.value), np.zeros((2, BUCKETS), np.int32)
        rows = np.zeros(2, np.int64)
        for part in text_slices(batches, "text"):
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                total[int(y > 0), list(features.of(text))] += 1
                rows[int(y > 0)] += 1
        width = BUCKETS // 64
        some = [(k, y) for k in range(64) for y in (0, 1)]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([k for k, _ in some], pa.int32()), "y": pa.array([y for _, y in some], pa.int32()),
            "rows": pa.array([int(rows[y]) for _, y in some], pa.int64()),
            "n": [total[y, k * width: (k + 1) * width].tobytes() for k, y in some]})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS // 64
        total, rows, key = np.zeros((2, width), np.int64), np.zeros(2, np.int64), 0
        for batch in batches:
            for k, y, r, n in zip(*[batch.column(c) for c in ("chunk", "y", "rows", "n")]):
                key = k.as_py()
                total[y.as_py()] += np.frombuffer(n.as_buffer(), np.int32)
                rows[y.as_py()] += r.as_py()
        some = np.flatnonzero(total[1] >= 5)
        odds = np.log((total[1] + 0.5) / (rows[1] + 1)) - np.log((total[0] + 0.5) / (rows[0] + 1))
        worth = odds * np.sqrt(total[1])
        some = some[np.argsort(-worth[some], kind="stable")][:FEATURES]
        some = some[odds[some] > 1.0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some + key * width), "odds": pa.array(odds[some]), "worth": pa.array(worth[some])})

    counted = mine.mapInArrow(count, "chunk int, y int, rows long, n binary")
    found = counted.groupBy("chunk").applyInArrow(pick, "bucket long, odds double, worth double").orderBy(F.desc("worth"), "bucket").limit(FEATURES).collect()
    chosen = {r.bucket: k for k, r in enumerate(found)}
    sent = spark.sparkContext.broadcast(chosen)

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value, sent.value)
        for part in text_slices(batches, "text"):
            own = [sorted(features.of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), part.column("y")], names=["own", "y"])

    rows = [(r.own, int(r.y > 0)) for r in mine.mapInArrow(rows_of, "own array<int>, y int").collect()]
    rate = sum(y for _, y in rows) / len(rows) if rows else 0.0
    if rate in (0.0, 1.0) or not chosen:
        return {}, np.zeros(1), float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
    weights, bias = _fit(rows, len(chosen))
    return chosen, weights, bias


def score(docs: DataFrame, model: np.ndarray, fitted: tuple[dict[int, int], np.ndarray, float], text_col: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Return the ``keep`` columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, *fitted))
    names = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.col(text_col).alias("text"))
    shape = T.StructType([*[T.StructField(k, picked.schema[k].dataType) for k in names], T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, chosen, weights, bias = shared.value
        features = Features(table, chosen)
        for part in text_slices(batches, "text"):
            z = np.array([bias + sum(weights[k] for k in features.of(t)) for t in part.column("text").to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], pa.array(p)], names=[*names, "score"])

    out = picked.mapInArrow(run, shape)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
