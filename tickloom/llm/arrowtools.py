"""Small helpers for functions that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A slice of texts handled at once inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts joined, and the n + 1 offsets; a null text is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        lengths = np.where(valid, np.diff(bounds), 0)
        if int(lengths.sum()) != int(bounds[-1] - bounds[0]):  # bytes below a null
            joined = b"".join(x.as_py() or b"" for x in column)
            return np.frombuffer(joined, np.uint8), np.r_[0, np.cumsum(lengths)]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def text_slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8_buffers(batch.column(batch.schema.get_field_index(text_col)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def table_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema | None = None) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % divisor


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(messages: DataFrame, n_buckets: int) -> DataFrame:
    """Messages by ``bucket``, a task for each two where there are more buckets than the session's partitions hold in twos."""
    n = -(-n_buckets // 2)
    return messages.repartition(n, "bucket") if n > partitions(messages) else messages


def raw_texts(column: pa.Array) -> list[bytes]:
    """Every text's bytes; a null text is empty."""
    data, bounds = utf8_buffers(column)
    raw, bounds = data.tobytes(), bounds.tolist()
    return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def map_texts(docs: DataFrame, text_col: str, keep: tuple[str, ...], extra: str,
              run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], limit: int = SLICE_BYTES) -> DataFrame:
    """The ``keep`` columns of every row, then new columns that ``run`` makes of slices with a ``text`` column.

    ``extra`` is the DDL of the new columns.  Columns travel under names of their own, so whatever the input's columns
    are called, nothing clashes.
    """
    names = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col(f"`{text_col}`").alias("text"))
    made = T.StructType.fromDDL(extra)
    shape = T.StructType([*[T.StructField(k, picked.schema[k].dataType) for k in names], *made])

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "text", limit):
                slices.append(part)
                yield part

        for columns in run(noted()):
            part = slices.pop()
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], *columns], names=[*names, *made.names])

    out = picked.mapInArrow(mapped, shape)
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], *made.names)
