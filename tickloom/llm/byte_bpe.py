"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine.

A rank file orders the merges of a byte-level BPE.  The tokens of a piece are the one sequence in
which every two neighbours stay apart, that is, in which the merges of the two joined give the two
again.  So each prefix of a piece has one last token, and the last token after the next byte follows
from those of the prefixes at which a longer token may have begun.  This is the transducer's
state: how far back such tokens may begin, the bytes since, and the last token of each of these prefixes.  An edge gives
the last token after its byte.  Where the tokens that lead to all places of the state agree they can no longer change,
whatever follows, and are emitted; what is held back has a bound that comes from the longest token.  States and edges are
made when they are first met (``MAX_STATES`` of them are held, then the table starts afresh), so a piece costs one step a byte, however long.

Texts are split into pieces by a pattern; a task remembers the ids of pieces it has met, at most ``CACHE``.
Everything happens where a document is read: there is no shuffle, and nothing but the vocabulary is held.

Defined results: a null text is empty and has no ids.  Bytes that are no UTF-8 are read as U+FFFD.
Repeated rows are encoded alike; an empty table gives an empty one.  In decoding an unknown or null id is an error,
a null list is empty, and bytes that form no character become U+FFFD in the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.arrowtools import map_texts, raw_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: States of a transducer and remembered pieces of a task.
MAX_STATES = 200_000
CACHE = 1_000_000
#: Characters of a text that are split into pieces at once.
CHUNK = 1 << 18
_START = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by bytes and by id, proper beginnings of tokens, and which tokens may stand side by side."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.beginnings = {token[:k] for token in self.ranks for k in range(1, len(token))}
        self.longest = max(map(len, self.ranks))
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has every single byte")
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}

    def merged(self, data: bytes, below: int) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none below a rank is left: for a few bytes only."""
        parts = [data[k: k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; none for a single byte."""
        if token not in self._halves:
            parts = self.merged(self.token[token], token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        """Whether merges ever give the token."""
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether ``right`` is ever made and can follow ``left``."""
        pair = left << 32 | right
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) > 4 * MAX_STATES:
                self._apart.clear()
            known = self._apart[pair] = self.made(right) and (left == _START or self._stands(left, right))
        return known

    def _stands(self, left: int, right: int) -> bool:
        """Whether the border between two tokens stands.

        The merges of both are taken back from the last one on.  If at some time the tokens that then meet
        at the border could merge before the merge that was taken back last, the border does not stand.
        """
        before = len(self.ranks)
        while True:
            if self.ranks.get(self.token[left] + self.token[right], before) < before:
                return False
            # of equal merges the left one came first
            parts = self.halves(left) if left > right else self.halves(right)
            if left > right and parts:
                before, left = left, parts[1]
            elif parts:
                before, right = right + 1, parts[0]
            elif self.halves(left if left <= right else right):  # the later one is a byte
                if left > right:
                    before, right = right + 1, self.halves(right)[0]
                else:
                    before, left = left, self.halves(left)[1]
            else:
                return True


class _State(dict):
    """Edges of a state: byte -> (next state, last token); an edge is made when it is first taken.

    ``suffix`` holds the last bytes, ``places`` a pair (bytes since, last token) for every prefix at which a token
    may have begun that is longer than what follows the prefix; the furthest first, the whole input last.
    """

    __slots__ = ("suffix", "places", "owner")

    def __init__(self, suffix: bytes, places: tuple, owner: Transducer) -> None:
        super().__init__()
        self.suffix, self.places, self.owner = suffix, places, owner

    def __missing__(self, byte: int) -> tuple[_State, int]:
        return self.owner.grow(self, byte)


class Transducer:
    """Deterministic states over bytes, made on demand."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES) -> None:
        self.words = vocabulary
        self.max_states = max_states
        self.window = 4 * vocabulary.longest
        self.longest_wait = 0
        self.size = {rank: len(token) for rank, token in vocabulary.token.items()}
        self.states: dict[tuple, _State] = {}
        self.start = self._intern(b"", ((0, _START),))

    def _intern(self, suffix: bytes, places: tuple) -> _State:
        known = self.states.get((suffix, places))
        if known is None:
            known = self.states[suffix, places] = _State(suffix, places, self)
        return known

    def grow(self, state: _State, byte: int) -> tuple[_State, int]:
        """The edge of a state for a byte."""
        read = state.suffix + bytes([byte])
        ranks, beginnings, last, kept, n = self.words.ranks, self.words.beginnings, -1, [], len(read) - 1
        for since, token in state.places:
            piece = read[n - since:]
            if last < 0:
                rank = ranks.get(piece, -1)
                if rank >= 0 and self.words.apart(token, rank):
                    last = rank
            if piece in beginnings:
                kept.append((since + 1, token))
        full = len(self.states) >= self.max_states
        if full:
            for old in self.states.values():  # states refer to each other
                old.clear()
            self.states.clear()
            self.start = self._intern(b"", ((0, _START),))
        made = self._intern(read[len(read) - kept[0][0]:] if kept else b"", (*kept, (0, last))), last
        if not full:
            state[byte] = made
        return made

    def _settle(self, out: list[int], lasts: list[int], state: _State) -> list[int]:
        """Emit what all places of the state have in common; the rest of ``lasts`` is held back."""
        places = {len(lasts) - since for since, _ in state.places}
        while len(places) > 1:
            furthest = max(places)
            places.remove(furthest)
            places.add(furthest - self.size[lasts[furthest - 1]])
        common = places.pop()
        self._emit(out, lasts[:common])
        self.longest_wait = max(self.longest_wait, len(lasts) - common)
        return lasts[common:]

    def _emit(self, out: list[int], lasts: list[int]) -> None:
        """Tokens back from the last one."""
        tokens, at = [], len(lasts)
        while at:
            token = lasts[at - 1]
            tokens.append(token)
            at -= self.size[token]
        out += tokens[::-1]

    def ids(self, piece: bytes) -> list[int]:
        out: list[int] = []
        lasts: list[int] = []
        state = self.start
        for at in range(0, len(piece), self.window):
            if at:
                lasts = self._settle(out, lasts, state)
            add = lasts.append
            for byte in piece[at: at + self.window]:
                state, last = state[byte]
                add(last)
        self._emit(out, lasts)
        return out


@lru_cache(1)
def _later_characters() -> tuple[str, str]:
    """Letters and numbers of this pattern engine that the tokenizer library's tables do not have yet: the first one, and a set of all."""
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    later: set[int] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        later |= set(map(ord, set(regex.findall(kind, text)) - set(bytes(library.encode_ordinary(text)).decode())))
    codes = np.array(sorted(later) or [0x10FFFF])
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return chr(codes[0]), "[" + "".join(rf"\U{r[0]:08X}-\U{r[-1]:08X}" for r in runs) + "]"


#: Below this character all versions of the tables agree, and classes are short lists of ranges.
_PLAIN_END = 0x530


def _ranges(kind: str) -> str:
    codes = np.array([c for c in range(_PLAIN_END) if regex.match(kind, chr(c))])
    return "".join(rf"\u{r[0]:04x}-\u{r[-1]:04x}" for r in np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1))


def _spelt_out(pattern: str) -> str:
    """The pattern with its Unicode classes written as ranges, for texts of plain characters."""
    out, inside, blank = [], False, _ranges(r"\s")
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part in "[]":
            inside = part == "["
        if part == r"\S" and not inside:
            part = f"[^{blank}]"
        elif part == r"\s" or part.startswith(r"\p{"):
            part = _ranges(part) if inside else f"[{_ranges(part)}]"
        out.append(part)
    return "".join(out)


class Splitter:
    """Cuts texts into pieces by a pattern, a bounded stretch at a time."""

    def __init__(self, pattern: str = public_tokenizers.PATTERN) -> None:
        self.pattern = pattern
        self.plain = re.compile(_spelt_out(pattern))
        self.full = regex.compile(pattern)
        self.edge = regex.compile(r"\S(?=\s)")
        self.older: regex.Pattern | None = None

    def _chosen(self, text: str) -> regex.Pattern | re.Pattern:
        if text.isascii() or ord(max(text)) < _PLAIN_END:
            return self.plain
        first, later = _later_characters()
        if max(text) < first or not regex.search(later, text):
            return self.full
        if self.older is None:
            classes = self.pattern.replace(r"\p{L}", rf"[\p{{L}}--{later}]").replace(r"\p{N}", rf"[\p{{N}}--{later}]")
            self.older = regex.compile("(?V1)" + classes)
        return self.older

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of consecutive pieces; stretches end before white space, where a piece always ends."""
        pattern, at = self._chosen(text), 0
        while at < len(text):
            found = self.edge.search(text, at + CHUNK) if at + CHUNK < len(text) else None
            stop = found.end() if found else len(text)
            yield pattern.findall(text[at:stop])
            at = stop


class _Pieces(dict):
    """Ids of pieces as little-endian 32-bit integers, found when they are first asked for."""

    def __init__(self, words: Vocabulary) -> None:
        super().__init__()
        self.ranks = words.ranks
        self.packed = {rank: rank.to_bytes(4, "little") for rank in words.token}
        self.transducer = Transducer(words)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        data = piece.encode()
        whole = self.ranks.get(data)  # as in the library, a piece that is a token needs no merges
        packed = self.packed
        self[piece] = found = packed[whole] if whole is not None else b"".join([packed[k] for k in self.transducer.ids(data)])
        return found


class Encoder:
    """Ids of texts under one vocabulary and pattern; a task holds one."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.words = Vocabulary(path)
        self.seen = _Pieces(self.words)
        self.transducer = self.seen.transducer
        self.splitter = Splitter(pattern)

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids in order, a stretch at a time."""
        for pieces in self.splitter.pieces(text):
            yield np.frombuffer(b"".join(map(self.seen.__getitem__, pieces)), "<u4")


class Utf8Machine:
    """Reads bytes one at a time: what it waits for is the state, characters come out when they are complete."""

    def __init__(self) -> None:
        self.held = b""
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def _begin(self, byte: int) -> str:
        if byte < 0x80:
            return chr(byte)
        self.need = 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
        if not self.need:
            return "�"
        # no overlong forms, no surrogates, nothing above U+10FFFF
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        self.held = bytes([byte])
        return ""

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if not self.need:
                out.append(self._begin(byte))
            elif self.low <= byte <= self.high:
                self.held += bytes([byte])
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                    self.held = b""
            else:
                out.append(self.finish() + self._begin(byte))
        return "".join(out)

    def finish(self) -> str:
        """U+FFFD for a character that was cut off."""
        cut, self.held, self.need = bool(self.held), b"", 0
        return "�" if cut else ""


class StreamDecoder:
    """Text of ids that arrive in portions; a character split over tokens or portions comes out once it is complete."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = vocabulary
        self.machine = Utf8Machine()
        self.whole = whole_tokens(vocabulary)

    def feed(self, ids: np.ndarray) -> tuple[bytes, str]:
        """Bytes of the ids, and the characters that are complete by now."""
        tokens = list(map(self.words.token.__getitem__, ids.tolist()))
        data = b"".join(tokens)
        parts = np.flatnonzero(~self.whole[ids]).tolist()
        if not parts and not self.machine.held:
            return data, data.decode()
        out, at = [], 0
        while at < len(tokens):
            if not self.machine.held:  # up to the next part of a character all tokens are text
                stop = next((p for p in parts if p >= at), len(tokens)) if parts and parts[-1] >= at else len(tokens)
                out.append(b"".join(tokens[at:stop]).decode())
                at = stop
            if at < len(tokens):
                out.append(self.machine.feed(tokens[at]))
                at += 1
        return data, "".join(out)

    def finish(self) -> str:
        return self.machine.finish()


def whole_tokens(vocabulary: Vocabulary) -> np.ndarray:
    """For each id whether its token is text by itself."""
    whole = np.zeros(max(vocabulary.token) + 1, bool)
    for rank, token in vocabulary.token.items():
        machine = Utf8Machine()
        whole[rank] = token.isascii() or ("�" not in machine.feed(token) and not machine.held)
    return whole


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The ``keep`` columns and ``ids``, an array of token ids, of every text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(slices: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder = _encoder(path, pattern)
        for part in slices:
            ids = [np.concatenate([np.zeros(0, "<u4"), *encoder.encode(t.decode("utf-8", "replace"))]) for t in raw_texts(part.column("text"))]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield [pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))]

    return map_texts(docs, text_col, keep, "ids array<int>", run, limit=1 << 20)


def decode(tokens: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``text`` of every list of ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = [f"k{i}" for i in range(len(keep))]
    picked = tokens.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    shape = T.StructType([*[T.StructField(k, picked.schema[k].dataType) for k in names], T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _encoder(path, public_tokenizers.PATTERN).words
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder = StreamDecoder(words)
                texts.append(decoder.feed(np.asarray(ids.as_py() or [], np.int64))[1] + decoder.finish())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], pa.array(texts, pa.string())], names=[*names, "text"])

    out = picked.mapInArrow(run, shape)
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], "text")


def round_trip(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode every text and decode its ids again, without storing them.

    Returns the ``keep`` columns, ``n_tokens``, the digests of the ids (decimal, one blank between) and of the decoded
    bytes, and ``n_chars``, the characters that the streaming decoder gave.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(slices: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder = _encoder(path, pattern)
        decimal = {k: str(k).encode() for k in encoder.words.token}
        decoder = StreamDecoder(encoder.words)
        for part in slices:
            rows = []
            for text in raw_texts(part.column("text")):
                count, chars, listed, decoded = 0, 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.encode(text.decode("utf-8", "replace")):
                    listed.update((b" " if count else b"") + b" ".join(map(decimal.__getitem__, ids.tolist())))
                    data, said = decoder.feed(ids)
                    decoded.update(data)
                    count += len(ids)
                    chars += len(said)
                rows.append((count, listed.hexdigest(), decoded.hexdigest(), chars + len(decoder.finish())))
            yield [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))]

    return map_texts(docs, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long", run)
