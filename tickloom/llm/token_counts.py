"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

One shuffle does the join.  A task cuts its documents into slices and sends, for every
bucket of pre-tokens, one compact row: the slice's distinct pre-tokens of that bucket and the
(document, pre-token, frequency) triples.  A bucket holds all occurrences of its pre-tokens,
so each distinct one is given to the tokenizer once; the bucket answers each slice with
partial sums per document, and a second, small shuffle adds them up.  No ids are built.

Frequent pre-tokens cost one entry per slice and document in compact arrays, after
aggregation inside the slice; a bucket is a hash range of all pre-tokens, so their number
follows the session's shuffle partitions and no group grows with a single key.

Defined results: a null text is empty (0 bytes, 0 tokens); special strings inside a text count as
one token each, as the library has it by default; repeated rows and null ids keep their own
rows; an empty table gives an empty result.  Texts that leave the simple character range are
counted by the library itself inside the slice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm import bpe
from tickloom.llm.arrowtools import dealt, partitions, text_slices, utf8_buffers

LIMIT = 2048
#: Text whose pre-tokens are shared out together.
SLICE = 8 << 20
#: Text whose pre-tokens share a bucket.
BUCKET_BYTES = 32 << 20


def _default_path() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


def _frequencies(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """Distinct pre-tokens, the triples sorted by pre-token, and the texts that need the library."""
    chunk_no: dict[str, int] = {}
    docs, terms, odd = [], [], {}
    for i, text in enumerate(texts):
        if not bpe.simple(text):
            odd[i] = text
            continue
        got = [chunk_no.setdefault(w, len(chunk_no)) for w in bpe.chunks(text)]
        terms.append(np.asarray(got, np.int32))
        docs.append(np.full(len(got), i, np.int32))
    # chunks to pre-tokens: once per distinct chunk of the slice
    pre_no: dict[str, int] = {}
    lengths = np.zeros(len(chunk_no), np.int64)
    flat: list[int] = []
    for k, chunk in enumerate(chunk_no):
        found = bpe.pretokens(chunk)
        lengths[k] = len(found)
        flat.extend([pre_no.setdefault(p, len(pre_no)) for p in found])
    term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    starts = np.r_[0, np.cumsum(lengths)]
    n = lengths[term]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.asarray(flat, np.int64)[np.repeat(starts[term], n) + within]
    del within
    pairs *= len(texts)
    pairs += np.repeat(doc, n)
    pairs, freq = np.unique(pairs, return_counts=True)
    return list(pre_no), pairs // len(texts), pairs % len(texts), freq, odd


def _buckets(docs: DataFrame, text_col: str) -> int:
    """A bucket's distinct pre-tokens are held by one task: their number comes from the bytes of the texts."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first().n or 0
    return max(2 * partitions(docs), -(-n_bytes // BUCKET_BYTES))


def count_tokens(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT,
                 tokenizer: str | None = None, buckets: int | None = None) -> DataFrame:
    """Return the ``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    path = tokenizer or _default_path()
    n_buckets = buckets or _buckets(docs, text_col)
    picked = docs.select(
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"), F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"))
    kept_type = picked.schema["kept"].dataType

    exchange = T.StructType.fromDDL("bucket int, slice long, pre string, sizes binary, doc binary, freq binary")
    exchange.add("kept", T.ArrayType(kept_type)).add("bytes", T.BinaryType()).add("own", T.BinaryType())

    def share(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            _, bounds = utf8_buffers(part.column("text"))
            pre, which, doc, freq, odd = _frequencies([t or "" for t in part.column("text").to_pylist()])
            own = np.zeros(part.num_rows, np.int64)
            for i, text in odd.items():
                own[i] = len(bpe.library_ids(bpe.load(path), text))
            number = part.column("row")[0].as_py()
            bucket = np.fromiter((crc32(p.encode()) for p in pre), np.int64, len(pre)) % n_buckets
            order = np.argsort(bucket[which], kind="stable")
            edges = np.searchsorted(bucket[which][order], np.arange(n_buckets + 1))
            rows = [(number % n_buckets, number, "", b"", b"", b"", part.column("kept"), np.diff(bounds).tobytes(), own.tobytes())]
            for b in np.flatnonzero(np.diff(edges)):
                at = order[edges[b]: edges[b + 1]]
                mine = which[at]
                new = np.r_[True, mine[1:] != mine[:-1]]
                sizes = np.diff(np.r_[np.flatnonzero(new), len(mine)])
                rows.append((int(b), number, " ".join([pre[k] for k in mine[new]]), sizes.astype(np.uint32).tobytes(),
                             doc[at].astype(np.uint32).tobytes(), freq[at].astype(np.uint32).tobytes(), None, None, None))
            # one long row per bucket: columns are built by hand so that the kept structs stay Arrow
            yield _rows(rows, kept_type)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("slice")[i]
                if batch.column("bytes")[i].is_valid:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number.as_py()]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                         *[batch.column(c).slice(i, 1) for c in ("kept", "bytes", "own")]],
                        names=["slice", "doc", "sums", "kept", "bytes", "own"])
                    continue
                pre = batch.column("pre")[i].as_py().split(" ")
                new = [p for p in pre if p not in known]
                if new:
                    counter = counter or bpe.PieceCounts(path)
                    known.update(zip(new, counter.count(new).tolist()))
                sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), np.uint32)
                doc = np.frombuffer(batch.column("doc")[i].as_buffer(), np.uint32)
                freq = np.frombuffer(batch.column("freq")[i].as_buffer(), np.uint32)
                pieces = np.repeat(np.array([known[p] for p in pre], np.int64), sizes)
                sums = np.bincount(doc, freq * pieces).astype(np.int64)
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()]), pa.array([some.astype(np.uint32).tobytes()], pa.binary()),
                     pa.array([sums[some].astype(np.uint32).tobytes()], pa.binary()),
                     batch.column("kept").slice(i, 1), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())],
                    names=["slice", "doc", "sums", "kept", "bytes", "own"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = n_bytes = own = None
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("bytes")[i].is_valid:
                    kept = batch.column("kept").slice(i, 1).flatten()
                    n_bytes = np.frombuffer(batch.column("bytes")[i].as_buffer(), np.int64)
                    own = np.frombuffer(batch.column("own")[i].as_buffer(), np.int64)
                    continue
                doc = np.frombuffer(batch.column("doc")[i].as_buffer(), np.uint32)
                more = np.frombuffer(batch.column("sums")[i].as_buffer(), np.uint32)
                if len(doc):
                    if doc[-1] >= len(sums):
                        sums = np.r_[sums, np.zeros(int(doc[-1]) + 1 - len(sums), np.int64)]
                    sums[doc] += more
        total = own.copy()
        total[: len(sums)] += sums
        yield pa.RecordBatch.from_arrays([kept, pa.array(n_bytes), pa.array(total)], names=["kept", "n_bytes", "n_tokens"])

    back = T.StructType.fromDDL("slice long, doc binary, sums binary")
    back.add("kept", T.ArrayType(kept_type)).add("bytes", T.BinaryType()).add("own", T.BinaryType())
    done = T.StructType([T.StructField("kept", kept_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = dealt(picked.mapInArrow(share, exchange), n_buckets).groupBy("bucket").applyInArrow(answer, back).groupBy("slice").applyInArrow(add, done)
    return out.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))


def _rows(rows: list[tuple], kept_type: T.StructType) -> pa.RecordBatch:
    kept = rows[0][6]
    offsets = pa.array([0] + [len(kept)] * len(rows), pa.int32())
    valid = pa.array([False] + [True] * (len(rows) - 1))
    lists = pa.ListArray.from_arrays(offsets, kept, mask=valid)
    binary = lambda k: pa.array([r[k] for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.string()), binary(3), binary(4), binary(5), lists, binary(7), binary(8)],
        names=["bucket", "slice", "pre", "sizes", "doc", "freq", "kept", "bytes", "own"])
