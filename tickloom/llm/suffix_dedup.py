"""Repeated passages of a corpus by prefix-free parsing.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed.

1. *Parse.*  A hash of the last 8 bytes triggers where a phrase ends and the next begins;
   phrases overlap by the trigger, so no phrase is a prefix of another.  The parse depends on content
   alone: equal strings have equal phrases inside.
2. *Dictionary.*  Phrases are counted over the corpus.  A string with a phrase that
   occurs once cannot be repeated.
3. *Order.*  Each remaining string start is assigned to the rarest phrase inside the string, and the runs
   of starts with the same phrase (a piece of text around it) meet in that phrase's bucket, once per
   distinct piece and slice.  There two suffix arrays are built: the pieces sorted by what follows
   the phrase (the parse) and by what precedes it, read backwards (the dictionary's side), both
   with their longest common prefixes.  Two strings that start d bytes before the phrase are equal
   exactly if they fall in one class of the second array at depth d and of the first at depth length - d;
   combining both arrays gives all repeated starts, by bytes, not by fingerprints.
4. Starts go back to their slice, which removes what they cover.

Strings without a whole phrase inside (long runs without a trigger) are pieces of their own.
Documents are packed into slices of bounded size, which are the unit of all joins, so no
table of positions is ever shuffled; longer documents are cut into parts that overlap by
``length - 1`` bytes.  Copies of a document cost one piece per slice.  A phrase with many different
surroundings gathers them in one group; the group holds distinct pieces only.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts shorter than ``length``
are untouched; matches never cross documents; repeated rows are copies of each other.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.arrowtools import dealt, partitions, utf8_buffers
from tickloom.llm.shingles import mix
from tickloom.session import materialise

LENGTH = 200
#: Text whose pieces share a bucket.
BUCKET_BYTES = 32 << 20
SLICE = 2 << 20
_TRIGGER = 8
#: One position in so many is a trigger, on average.
_EVERY_BITS = 4
_BASE = 0xD6E8FEB86659FD93
_MOST = 255


def _zip(data: bytes) -> bytes:
    return pa.Codec("zstd", 6).compress(data, asbytes=True)


def _unzip(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b""


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])
    return up, down


_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


class Parse:
    """Phrases of the items of a slice: starts, ends, hashes and the item of each; only those that fit in a string."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, length: int) -> None:
        n = len(raw)
        self.raw, self.bounds, self.length = raw, bounds, length
        if n >= _TRIGGER:
            eight = np.ndarray((n - _TRIGGER + 1,), "<u8", raw.tobytes(), 0, (1,))
            at = np.flatnonzero((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _EVERY_BITS) == 0)
            item = np.searchsorted(bounds, at, "right") - 1
            inside = at + _TRIGGER <= bounds[item + 1]
            at, item = at[inside], item[inside]
        else:
            at, item = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = 1 << max(16, int(n).bit_length())
        self.up, self.down = _powers(size)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * self.up[:n], out=self.total[1:])
        whole = item[1:] == item[:-1] if len(at) else np.zeros(0, bool)
        whole &= at[1:] + _TRIGGER - at[:-1] <= length
        self.start, self.end, self.item = at[:-1][whole], at[1:][whole] + _TRIGGER, item[:-1][whole]
        self.hash = self.of(self.start, self.end)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def _bucketed(distinct: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct hashes by bucket, and the buckets' edges."""
    bucket = (distinct % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _rarest(parse: Parse, frequency: np.ndarray, own_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [a, b) of string starts with the number of their rarest phrase; -1 where no whole phrase is inside.

    Starts of strings with a phrase that occurs once are left out.
    """
    length, bounds = parse.length, parse.bounds
    first, last = bounds[:-1], np.minimum(own_end, bounds[1:] - length + 1)  # starts of item k: first[k] <= i < last[k]
    some = last > first
    # a run ends where the first or the last phrase inside the string changes
    enter, leave = parse.end - length, parse.start + 1
    cuts = np.unique(np.concatenate([first[some], last[some], np.maximum(enter, 0), leave]))
    if len(cuts) < 2:
        return (np.zeros(0, np.int64),) * 3
    a, b = cuts[:-1], cuts[1:]
    item = np.clip(np.searchsorted(bounds, a, "right") - 1, 0, len(first) - 1)
    ok = (a >= first[item]) & (b <= last[item])
    a, b = a[ok], b[ok]
    lo, hi = np.searchsorted(parse.start, a, "left"), np.searchsorted(parse.end, a + length, "right")
    n = len(parse.start)
    rank = np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), parse.hash, frequency))
    rank[order] = np.arange(n)
    # equal phrases get one rank, so that the leftmost of them wins by position
    same = np.r_[False, (parse.hash[order][1:] == parse.hash[order][:-1])] if n else np.zeros(0, bool)
    tied = np.arange(n)
    tied = np.maximum.accumulate(np.where(same, 0, tied))
    rank[order] = tied
    key = rank * (n + 1) + np.arange(n)
    levels = [key]
    while len(levels[-1]) > 1 and 1 << len(levels) <= length:
        half = 1 << (len(levels) - 1)
        prev = levels[-1]
        if len(prev) <= half:
            break
        levels.append(np.minimum(prev[:-half], prev[half:]))
    width = hi - lo
    best = np.full(len(a), -1, np.int64)
    inside = width > 0
    level = np.zeros(len(a), np.int64)
    level[inside] = np.minimum(np.floor(np.log2(width[inside])).astype(np.int64), len(levels) - 1)
    for k, table in enumerate(levels):
        at = np.flatnonzero(inside & (level == k))
        if len(at):
            best[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)]) % (n + 1)
    keep = (best < 0) | (frequency[np.maximum(best, 0)] > 1 if n else True)
    a, b, best = a[keep], b[keep], best[keep]
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    joined = np.r_[True, (best[1:] != best[:-1]) | (a[1:] != b[:-1]) | (best[1:] < 0)]
    starts = np.flatnonzero(joined)
    stops = np.r_[starts[1:], len(a)] - 1
    return a[starts], b[stops], best[starts]


def repeated_starts(pieces: list[tuple[int, int, int, bytes]], many: np.ndarray, length: int) -> list[np.ndarray]:
    """For distinct pieces (phrase, bytes before it, starts, text): which of its starts are repeated.

    ``many`` marks pieces that occur more than once.
    """
    m = len(pieces)
    out = [np.full(p[2], bool(many[u])) for u, p in enumerate(pieces)]
    phrase = np.array([p[0] for p in pieces], np.uint64)
    before, starts = np.array([p[1] for p in pieces], np.int64), np.array([p[2] for p in pieces], np.int64)
    right = [p[3][p[1]: p[1] + length] for p in pieces]
    left = [p[3][: p[1]][::-1] for p in pieces]
    classes = [_SuffixOrder(phrase, side, length) for side in (right, left)]
    order_r, order_l = classes
    result = np.repeat(many, starts)
    base = np.r_[0, np.cumsum(starts)]
    for d in range(int(before.max()) + 1 if m else 0):  # strings that start d bytes before the phrase
        at = np.flatnonzero((before >= d) & (before - d < starts))
        if len(at) < 2:
            continue
        both = order_r.at_depth(length - d)[at] * m + order_l.at_depth(d)[at]
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        twin = np.r_[False, ranked[1:] == ranked[:-1]]
        twin[:-1] |= twin[1:].copy()
        hit = at[order[twin]]
        result[base[hit] + before[hit] - d] = True
    return [result[base[u]: base[u + 1]] for u in range(m)] if m else out


class _SuffixOrder:
    """Texts sorted inside their phrase, with the longest common prefix of neighbours."""

    def __init__(self, phrase: np.ndarray, texts: list[bytes], length: int) -> None:
        keys = [p.tobytes() + t for p, t in zip(phrase.astype(">u8"), texts)]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        size = np.array([len(t) for t in texts], np.int64)[self.order]
        self.common = np.zeros(len(keys), np.int64)
        self.bound = np.ones(len(keys), bool)  # a new phrase begins
        self.bound[1:] = phrase[self.order][1:] != phrase[self.order][:-1]
        for k in range(0, len(keys), 4096):
            rows = self.order[max(0, k - 1): k + 4096]
            table = np.frombuffer(b"".join(texts[u].ljust(length, b"\0") for u in rows), np.uint8).reshape(len(rows), length)
            differ = table[1:] != table[:-1]
            lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
            self.common[max(1, k): max(1, k) + len(lcp)] = lcp
        self.common[1:] = np.minimum(self.common[1:], np.minimum(size[1:], size[:-1]))

    def at_depth(self, depth: int) -> np.ndarray:
        """Class of each text: texts with a common prefix of ``depth`` bytes (and one phrase) share it."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.bound | (self.common < depth)) - 1
        return out


def _pack(docs: DataFrame, keep: tuple[str, ...], text_col: str, length: int, slice_bytes: int) -> DataFrame:
    """Slices: one row with the compressed texts of many documents, or a part of a long one."""
    picked = docs.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"),
                         F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kept_type = picked.schema["kept"].dataType
    shape = T.StructType.fromDDL("slice string, size long, data binary, own binary, bounds binary, part int, parts int")
    shape.add("kept", T.ArrayType(kept_type))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffers(batch.column("text"))
            sizes, rows, at = np.diff(bounds), batch.column("row").to_numpy(), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + slice_bytes, "right")) - 1)
                kept = batch.column("kept").slice(at, stop - at)
                if stop == at + 1 and sizes[at] > slice_bytes:
                    parts = -(-int(sizes[at]) // slice_bytes)
                    for k in range(parts):
                        lo = int(bounds[at]) + k * slice_bytes
                        own = min(slice_bytes, int(bounds[at + 1]) - lo)
                        hi = min(lo + own + length - 1, int(bounds[at + 1]))
                        yield made(f"{rows[at]}:{k}", data[lo:hi], [own], [0, hi - lo], k, parts, kept)
                else:
                    edge = bounds[at: stop + 1] - bounds[at]
                    yield made(f"{rows[at]}:0", data[bounds[at]: bounds[stop]], edge[1:], edge, 0, 1, kept)
                at = stop

    def made(name: str, data: np.ndarray, own: np.ndarray, edge: np.ndarray, part: int, parts: int, kept: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.string()), pa.array([len(data)], pa.int64()), pa.array([_zip(data.tobytes())], pa.binary()),
             pa.array([np.asarray(own, np.int64).tobytes()], pa.binary()), pa.array([np.asarray(edge, np.int64).tobytes()], pa.binary()),
             pa.array([part], pa.int32()), pa.array([parts], pa.int32()),
             pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)],
            names=["slice", "size", "data", "own", "bounds", "part", "parts", "kept"])

    return picked.mapInArrow(pack, shape)


def _opened(table: pa.Table | pa.RecordBatch, i: int, length: int) -> tuple[Parse, np.ndarray]:
    raw = np.frombuffer(_unzip(table.column("data")[i].as_py(), table.column("size")[i].as_py()), np.uint8)
    return Parse(raw, np.frombuffer(table.column("bounds")[i].as_py(), np.int64), length), np.frombuffer(table.column("own")[i].as_py(), np.int64)


def _phrase_counts(slices: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """``(slice, bucket, found)``: corpus frequencies, up to 255, of a slice's distinct phrases, in bucket order."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parse, own = _opened(batch, i, length)
                distinct, code = np.unique(parse.hash, return_inverse=True)
                # a phrase that starts in the overlap is counted by the next part
                n = np.bincount(code, parse.start < own[parse.item], minlength=len(distinct))
                order, edges = _bucketed(distinct, n_buckets)
                some = np.flatnonzero(np.diff(edges))
                short = (distinct[order] >> np.uint64(32)).astype(np.uint32)
                count = np.minimum(n[order], _MOST).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([batch.column("slice")[i].as_py()] * len(some), pa.string()),
                     pa.array([short[edges[b]: edges[b + 1]].tobytes() for b in some], pa.binary()),
                     pa.array([count[edges[b]: edges[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "slice", "short", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, short, count = [], [], []
        for batch in batches:
            names += batch.column("slice").to_pylist()
            short += [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("short")]
            count += [np.frombuffer(x.as_py(), np.uint8) for x in batch.column("n")]
            key = batch.column("bucket")[0].as_py()
        _, code = np.unique(np.concatenate(short), return_inverse=True)
        total = np.minimum(np.bincount(code, np.concatenate(count)), _MOST).astype(np.uint8)[code]
        edges = np.r_[0, np.cumsum([len(x) for x in short])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([key] * len(names), pa.int32()),
             pa.array([total[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["slice", "bucket", "found"])

    sent = slices.select("slice", "size", "data", "own", "bounds").mapInArrow(send, "bucket int, slice string, short binary, n binary")
    return dealt(sent, n_buckets).groupBy("bucket").applyInArrow(answer, "slice string, bucket int, found binary")


_MESSAGE = "bucket int, slice string, phrase binary, before binary, starts binary, place binary, many binary, size long, text binary, a binary, b binary"


def _pieces(slices: DataFrame, counts: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Messages to the phrases' buckets: distinct pieces of a slice; and the starts known to be repeated inside the slice."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {k: [] for k in ("bucket", "slice", "phrase", "before", "starts", "place", "many", "size", "text", "a", "b")}
        if left.num_rows:
            _cut_slice(left, right, length, n_buckets, rows)
        return pa.table([pa.array(rows[f.name], kind) for f, kind in zip(_fields, _kinds)], names=[f.name for f in _fields])

    _fields = T.StructType.fromDDL(_MESSAGE).fields
    _kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in _fields]
    return slices.select("slice", "size", "data", "own", "bounds").groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(cut, _MESSAGE)


def _cut_slice(left: pa.Table, right: pa.Table, length: int, n_buckets: int, rows: dict[str, list]) -> None:
    parse, own = _opened(left, 0, length)
    name = left.column("slice")[0].as_py()
    distinct, code = np.unique(parse.hash, return_inverse=True)
    order, edges = _bucketed(distinct, n_buckets)
    found = np.zeros(len(distinct), np.int64)
    for b, f in zip(right.column("bucket").to_pylist(), right.column("found")):
        found[order[edges[b]: edges[b + 1]]] = np.frombuffer(f.as_py(), np.uint8)
    a, b, phrase = _rarest(parse, found[code], parse.bounds[:-1] + own)
    # strings without a phrase: one piece per start
    lone = phrase < 0
    single = np.concatenate([np.arange(x, y) for x, y in zip(a[lone], b[lone])]) if lone.any() else np.zeros(0, np.int64)
    a, b = np.r_[a[~lone], single], np.r_[b[~lone], single + 1]
    key = np.r_[parse.hash[phrase[~lone]], parse.of(single, single + length)]
    before = np.r_[parse.start[phrase[~lone]], single] - a
    raw = parse.raw.tobytes()
    seen: dict[tuple[int, int, bytes], list[int]] = {}
    for k, (x, y, h, d) in enumerate(zip(a.tolist(), b.tolist(), key.tolist(), before.tolist())):
        seen.setdefault((h, d, raw[x: y + length - 1]), []).append(k)
    home = [k for ks in seen.values() if len(ks) > 1 for k in ks]  # repeated inside the slice
    place = np.array([ks[0] for ks in seen.values()], np.int64)
    many = np.array([len(ks) > 1 for ks in seen.values()], np.uint8)
    texts = [t for _, _, t in seen]
    bucket = (key[place] % np.uint64(n_buckets)).astype(np.int64) if len(place) else place
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        mine = by_bucket[edges[k]: edges[k + 1]]
        at = place[mine]
        joined = b"".join([texts[u] for u in mine])
        for column, value in (("bucket", int(k)), ("slice", name), ("phrase", key[at].tobytes()), ("before", before[at].astype(np.uint16).tobytes()),
                              ("starts", (b[at] - a[at]).astype(np.uint16).tobytes()), ("place", a[at].astype(np.uint32).tobytes()),
                              ("many", many[mine].tobytes()), ("size", len(joined)), ("text", _zip(joined)), ("a", None), ("b", None)):
            rows[column].append(value)
    if home:
        at = np.array(home)
        for column, value in (("bucket", crc32(name.encode()) % n_buckets), ("slice", name), ("a", a[at].astype(np.uint32).tobytes()), ("b", b[at].astype(np.uint32).tobytes()),
                              *((c, None) for c in ("phrase", "before", "starts", "place", "many", "size", "text"))):
            rows[column].append(value)


def _resolved(messages: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """``(slice, a, b)``: runs of repeated starts, found in each bucket from the order of its pieces."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[int, int, bytes], int] = {}
        seen: list[int] = []
        waiting: list[tuple[str, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("slice")[i].as_py()
                if batch.column("a")[i].is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *[batch.column(c).slice(i, 1) for c in ("a", "b")]], names=["slice", "a", "b"])
                    continue
                text = _unzip(batch.column("text")[i].as_py(), batch.column("size")[i].as_py())
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
                starts, many, at, mine = get("starts", np.uint16), get("many", np.uint8), 0, []
                for h, d, n, twice in zip(get("phrase", np.uint64).tolist(), get("before", np.uint16).tolist(), starts.tolist(), many.tolist()):
                    size = n + length - 1
                    u = number.setdefault((h, d, text[at: at + size]), len(number))
                    at += size
                    if u == len(seen):
                        seen.append(0)
                    seen[u] += 1 + twice
                    mine.append(u)
                once = many == 0  # the slice knows the others already
                waiting.append((name, np.array(mine, np.int64)[once], get("place", np.uint32)[once].astype(np.int64)))
        pieces = [(h, d, len(t) - length + 1, t) for h, d, t in number]
        if not pieces:
            return
        flags = repeated_starts(pieces, np.array(seen) > 1, length)
        runs = [_runs(f) for f in flags]
        for name, mine, place in waiting:
            a = [runs[u][0] + p for u, p in zip(mine.tolist(), place.tolist()) if len(runs[u][0])]
            b = [runs[u][1] + p for u, p in zip(mine.tolist(), place.tolist()) if len(runs[u][0])]
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([np.concatenate(a).astype(np.uint32).tobytes()], pa.binary()),
                     pa.array([np.concatenate(b).astype(np.uint32).tobytes()], pa.binary())], names=["slice", "a", "b"])

    return dealt(messages, n_buckets).groupBy("bucket").applyInArrow(resolve, "slice string, a binary, b binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH,
                   slice_bytes: int = SLICE, with_text: bool = False) -> DataFrame:
    """Return the ``keep`` columns with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and optionally the bytes ``kept_text``."""
    if not _TRIGGER * 2 < length <= 1024:
        raise ValueError("length must be above 16 and at most 1024")
    slices = materialise(_pack(docs, keep, text_col, length, slice_bytes))
    # a bucket's pieces are held by one task: their number comes from the bytes, not from the session
    n_bytes = slices.agg(F.sum("size").alias("n")).first().n or 0
    n_buckets = max(partitions(docs), -(-n_bytes // BUCKET_BYTES))
    counts = _phrase_counts(slices, length, n_buckets)
    found = _resolved(_pieces(slices, counts, length, n_buckets), length, n_buckets)
    kept_type = slices.schema["kept"].dataType.elementType

    parts_shape = T.StructType([T.StructField("doc", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("kept", kept_type),
                                *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, raw binary, mask binary").fields])
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.binary(),
             "raw": pa.binary(), "mask": pa.binary()}

    def digest(raw: np.ndarray, gone: np.ndarray) -> tuple:
        left = raw[~gone].tobytes() if gone.any() else raw.tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        return len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if with_text else None, None, None

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        doc, part = [], []
        kept = left.column("kept").combine_chunks().flatten() if left.num_rows else pa.array([], left.schema.field("kept").type.value_type)
        if left.num_rows:
            raw = np.frombuffer(_unzip(left.column("data")[0].as_py(), left.column("size")[0].as_py()), np.uint8)
            bounds = np.frombuffer(left.column("bounds")[0].as_py(), np.int64)
            change = np.zeros(len(raw) + 1, np.int32)
            for a, b in zip(right.column("a"), right.column("b")):
                np.add.at(change, np.frombuffer(a.as_py(), np.uint32), 1)
                np.add.at(change, np.frombuffer(b.as_py(), np.uint32).astype(np.int64) + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            name, whole = left.column("slice")[0].as_py(), left.column("parts")[0].as_py() == 1
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                doc.append(int(name.split(":")[0]))
                part.append(left.column("part")[0].as_py())
                out.append(digest(raw[a:b], gone[a:b]) if whole else (None, None, None, None, None, raw.tobytes(), np.packbits(gone).tobytes()))
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())]
        return pa.table([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), kept, *columns], names=["doc", "part", "kept", *kinds])

    def join_parts(table: pa.Table) -> pa.Table:
        """Parts of one long document; each overlaps the next."""
        order = np.argsort(table.column("part").to_numpy())
        raws = [np.frombuffer(table.column("raw")[int(i)].as_py(), np.uint8) for i in order]
        masks = [np.unpackbits(np.frombuffer(table.column("mask")[int(i)].as_py(), np.uint8), count=len(r)).astype(bool) for i, r in zip(order, raws)]
        total = slice_bytes * (len(raws) - 1) + len(raws[-1])
        raw, gone = np.zeros(total, np.uint8), np.zeros(total, bool)
        for k, (r, g) in enumerate(zip(raws, masks)):
            raw[k * slice_bytes: k * slice_bytes + len(r)] = r
            gone[k * slice_bytes: k * slice_bytes + len(r)] |= g
        row = digest(raw, gone)
        columns = [pa.array([row[k]], kind) for k, kind in enumerate(kinds.values())]
        first = table.slice(int(order[0]), 1)
        return pa.table([first.column("doc"), first.column("part"), first.column("kept"), *columns], names=["doc", "part", "kept", *kinds])

    cut = slices.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(drop, parts_shape)
    # long documents are known by their slices, whole ones need no second look
    long_slices = slices.where("parts > 1").select("slice")
    if long_slices.isEmpty():
        done = cut
    else:
        cut = materialise(cut)
        done = cut.where(F.col("raw").isNull()).unionByName(cut.where(F.col("raw").isNotNull()).groupBy("doc").applyInArrow(join_parts, parts_shape))
    return done.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept_sha256",
                       *(["kept_text"] if with_text else []))
