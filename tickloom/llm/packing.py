"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the plan is
made from their histogram: at most 4096 counts reach the driver whatever the number of documents.
A plan is a list of patterns (lengths that share a sequence) with the number of sequences
made by it.  A pattern is filled greedily with the longest length that still fits; then its
shortest member is replaced by two lengths that fill the enlarged gap more tightly, as long as that
helps.  It is used until one of its lengths runs out, so there are at most as many
patterns as lengths.

Pieces find their place by number: the k-th piece of a length takes the k-th slot of that
length.  Numbering is two-level (inside a stored partition, then partition offsets), so
a length shared by a third of all pieces is not one task, and the slots are joined as ranges of ranks.

Defined results: a null text is empty, and an empty document is one piece holding only the
end token.  Repeated rows and null ids are packed like any other row.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tickloom.llm import bpe
from tickloom.llm.arrowtools import text_slices
from tickloom.session import materialise

CAPACITY = 4096
END_ID = 1


def token_pieces(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY,
                 end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Tokenise whole documents, append the end token and cut those longer than ``capacity``.

    Returns the ``keep`` columns with ``piece``, ``start``, ``length`` and ``ids_crc32``.
    """
    path = tokenizer or str(public_tokenizers.path("word_bpe_49k.json"))
    names = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.col(text_col).alias("text"))
    shape = T.StructType([*[T.StructField(k, picked.schema[k].dataType) for k in names],
                          *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.ChunkIds(path)
        for part in text_slices(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    mine = ids[at: at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(mine) // 4)
                    crc.append(crc32(mine))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k).take(at) for k in names], pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[*names, "piece", "start", "length", "ids_crc32"])

    out = picked.mapInArrow(cut, shape)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "piece", "start", "length", "ids_crc32")


class _Stock:
    """Remaining number of pieces of each length; finds the longest available length up to a limit."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def best(self, limit: int, used: dict[int, int]) -> int:
        """The longest length of at most ``limit`` of which the pattern can take one more; 0 if none."""
        for length in np.flatnonzero(self.left[: limit + 1])[::-1].tolist():
            if self.left[length] > used.get(length, 0):
                return length
        return 0

    def best_pair(self, limit: int, above: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two available lengths with the largest sum in (above, limit]."""
        free = self.left.copy()
        for length, n in used.items():
            free[length] -= n
        open_ = np.flatnonzero(free[: limit + 1] > 0)
        if not len(open_):
            return None
        # for each first length the longest partner that fits; a pair of equals needs two pieces
        partner = np.searchsorted(open_, limit - open_, "right") - 1
        first, partner = open_[partner >= 0], partner[partner >= 0]
        second = open_[partner]
        alone = (second == first) & (free[first] < 2)
        partner = np.where(alone, partner - 1, partner)
        ok = partner >= 0
        first, second = first[ok], open_[partner[ok]]
        if not len(first):
            return None
        total = first + second
        k = int(total.argmax())
        return (int(first[k]), int(second[k])) if total[k] > above else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence) with their number of sequences; uses every piece once."""
    stock, out = _Stock(counts, capacity), []
    while stock.left.any():
        pattern, used, gap = [], {}, capacity
        while length := stock.best(gap, used):
            pattern.append(length)
            used[length] = used.get(length, 0) + 1
            gap -= length
        while gap and pattern:
            small = min(pattern)
            used[small] -= 1
            pair = stock.best_pair(gap + small, small, used)
            if not pair:
                used[small] += 1
                break
            pattern.remove(small)
            for length in pair:
                pattern.append(length)
                used[length] = used.get(length, 0) + 1
            gap -= sum(pair) - small
        times = min(int(stock.left[length]) // n for length, n in used.items() if n)
        for length, n in used.items():
            stock.left[length] -= n * times
        out.append((pattern, times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length that share a place in a pattern."""
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            first = rank.get(length, 0)
            out.append((length, first, first + times, sequence, offset))
            rank[length] = first + times
            offset += length
        sequence += times
    return out


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with lengths from 1 to ``capacity``."""
    spark = pieces.sparkSession
    given = F.struct(*[F.col(f"`{c}`") for c in pieces.columns])
    stored = materialise(pieces.select(given.alias("given"), F.col(f"`{length_col}`").alias("length"), F.spark_partition_id().alias("part")))
    sizes = materialise(stored.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(plan(counts, capacity))
    # one row per partition and length: they grow with the pieces, so they are merged, never broadcast
    base = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part", "length").orderBy(*[F.col(f"given.`{c}`") for c in pieces.columns if c != length_col])
    ranked = stored.withColumn("nth", F.row_number().over(inside) - 1).join(base.hint("merge"), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    # the slots of each length as sorted ranges of ranks: their number is bounded by the patterns and their places
    by_length: dict[int, list] = {}
    for length, first, end, sequence, offset in places:
        by_length.setdefault(length, []).append((first, end, sequence, offset))
    shared = spark.sparkContext.broadcast({k: np.asarray(v, np.int64) for k, v in by_length.items()})
    shape = T.StructType([stored.schema["given"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(order) else []
            for a, b in zip(edges[:-1], edges[1:]):
                at = order[a:b]
                ranges = shared.value[int(length[at[0]])]
                k = np.searchsorted(ranges[:, 0], rank[at], "right") - 1
                sequence[at] = ranges[k, 2] + rank[at] - ranges[k, 0]
                offset[at] = ranges[k, 3]
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(sequence), pa.array(offset)], names=["given", "sequence_id", "offset"])

    made = ranked.select("given", "length", "rank").mapInArrow(place, shape)
    return made.select(*[F.col(f"given.`{c}`").alias(c) for c in pieces.columns], "sequence_id", "offset")
