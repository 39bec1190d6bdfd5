"""Hashed word shingles of whole texts, vectorised over the bytes of a slice of documents."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words are runs of ASCII letters, digits and bytes of non-ASCII characters, after lower-casing.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
WORDS = 5
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random word per byte value."""
    rng = np.random.default_rng(20240501)
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.r_[np.uint64(1), np.cumprod(np.full(2 * _PIECE, base, np.uint64))]
        down = np.r_[np.uint64(1), np.cumprod(np.full(2 * _PIECE, inverse, np.uint64))]
    return up, down, rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a piece of folded text."""
    up, down, table = _powers()
    raw = np.frombuffer(folded, np.uint8)
    if len(raw) >= len(up):  # one word longer than a piece: hash it by a digest of its bytes
        import hashlib

        words, starts, at = folded.split(), [], 0
        for w in words:
            at = folded.index(w, at)
            starts.append(at)
            at += len(w)
        digest = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words]
        return np.asarray(starts, np.int64), np.asarray(digest, np.uint64)
    inside = raw != 0x20
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=total[1:])
    return first, mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def words(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after another in ``data``, and the n + 1 offsets into them.

    Texts must not touch: a blank stands between two of them (see ``join_texts``).
    """
    folded = data.translate(_FOLD)
    starts, hashes, at = [], [], 0
    while at < len(folded):
        stop = min(at + _PIECE, len(folded))
        if stop < len(folded):
            cut = folded.rfind(b" ", at, stop)
            stop = cut + 1 if cut >= at else (folded.find(b" ", stop) + 1 or len(folded))
        first, h = _word_hashes(folded[at:stop])
        starts.append(first + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def join_texts(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """Lower-cased texts with a blank after each, and the n + 1 offsets."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return b" ".join([*parts, b""]), np.r_[0, np.cumsum(lengths)]


def shingles(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (repeats included) and the n + 1 offsets.

    A text with fewer than ``size`` words, but not none, is one shingle.
    """
    hashes, bounds = words(*join_texts(texts))
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.r_[0, np.cumsum(count)]
    factors = mix(np.arange(1, size + 1, dtype=np.uint64))
    padded = np.r_[hashes, np.zeros(size, np.uint64)]
    first = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    h = np.zeros(len(first), np.uint64)
    left = np.repeat(bounds[1:], count) - first
    for k in range(size):
        h += np.where(left > k, padded[first + k] * factors[k], np.uint64(0))
    return mix(h + np.minimum(left, size).astype(np.uint64)), out
