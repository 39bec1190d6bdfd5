"""Exact, cached piece counts and ids for a word-level byte-pair tokenizer file.

The file's library never lets a piece cross white space or the edge of a pre-token, so a
white-space delimited chunk can be encoded once and reused.  ``simple`` texts hold only
characters for which lower-casing, composition and white space are the same in Python and in
the library; any other text is given to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Fixed by the tokenizer file: strings that it takes for one added token wherever they stand.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Entries of a task's cache of encoded chunks; it starts afresh when full.
CACHE = 1_200_000

_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
#: Fixed by the tokenizer file: its pre-token pattern, for lower-cased characters below U+0250.
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fİɐ-\U0010ffff]")


@lru_cache(2)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once per Python worker."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def simple(text: str) -> bool:
    return not _ODD.search(text) and "<|" not in text


def chunks(text: str) -> list[str]:
    """White-space delimited chunks of a simple text as the normaliser leaves them."""
    return text.lower().split()


def pretokens(chunk: str) -> list[str]:
    return _PRETOKEN.findall(chunk)


def library_ids(tokenizer: Tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids


class PretokenIds:
    """Encodes distinct pre-tokens many at a time; a piece with the word-end mark closes each."""

    BATCH = 4096

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for piece, k in vocabulary.items() if suffix and piece.endswith(suffix)]] = True

    def encode(self, pre: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the end of each pre-token's ids."""
        ids, ends, base = [], [], 0
        for at in range(0, len(pre), self.BATCH):
            part = pre[at: at + self.BATCH]
            found = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            close = np.flatnonzero(self.closes[found]) + 1
            if len(close) != len(part):  # an unknown piece: one by one
                each = [library_ids(self.tokenizer, p) for p in part]
                found = np.asarray([k for ids_ in each for k in ids_], np.uint32)
                close = np.cumsum([len(x) for x in each])
            ids.append(found)
            ends.append(close + base)
            base += len(found)
        return (np.concatenate(ids), np.concatenate(ends)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


class ChunkIds:
    """Ids of texts as little-endian 32-bit integers, chunk by chunk from a bounded cache."""

    def __init__(self, path: str) -> None:
        self.encoder = PretokenIds(path)
        self.seen: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        seen = self.seen
        new = list({w for w in words if w not in seen})
        if len(seen) + 2 * len(new) > CACHE:
            seen.clear()
            new = list(set(words))
        split = [pretokens(w) for w in new]
        pre = list({p for parts in split for p in parts if p not in seen})
        ids, ends = self.encoder.encode(pre)
        raw, at = ids.astype("<u4").tobytes(), 0
        for p, end in zip(pre, (4 * ends).tolist()):
            seen[p] = raw[at:end]
            at = end
        for w, parts in zip(new, split):
            if len(parts) > 1:
                seen[w] = b"".join([seen[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if not simple(text):
            return np.asarray(library_ids(self.encoder.tokenizer, text), "<u4").tobytes()
        words = chunks(text)
        try:
            return b"".join([self.seen[w] for w in words])
        except KeyError:
            self._learn(words)
        return b"".join([self.seen[w] for w in words])


class PieceCounts:
    """Number of pieces of single pre-tokens."""

    def __init__(self, path: str) -> None:
        self.encoder = PretokenIds(path)

    def count(self, pre: list[str]) -> np.ndarray:
        return np.diff(self.encoder.encode(pre)[1], prepend=0)
