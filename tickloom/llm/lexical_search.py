"""Ranked lexical search: the best documents of every test item, counted straight from the texts.

The terms of the items, each between two guards, form one Aho-Corasick automaton that is broadcast.  A folded text
has a guard wherever it has no term, so the automaton reports whole terms only, and a scan gives the
frequencies of the items' terms in a document; nothing is indexed or stored per document.  A first scan counts the
documents that hold each term, and all terms; a second one counts again, scores, and keeps the best
documents of every item in each task.  The tasks' lists meet in two steps, so that one item's lists are spread.

Weights and scores are integers.  An automaton holds the terms of at most ``BLOCK_BYTES`` of item text (or of one item); more
items are answered in blocks, each by scans of its own, so what is broadcast has a bound.

Defined results: terms are runs of ASCII letters (lower-cased), digits and other characters above U+007F.  Null and wordless
texts count nowhere; null and wordless items find nothing.  Repeated rows of documents are ranked each; repeated
rows of items are answered each.  Equal scores rank by ascending id, null ids last.  An empty table on either side gives no
rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tickloom.llm.arrowtools import raw_texts, text_slices

BEST = 10
#: Text and number of the items that are answered together.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 4096
#: Parts into which the tasks' lists of one item are dealt before they meet.
SPREAD = 64
#: Fixed by the definition of a term; every other byte becomes a guard.
_TERM_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes(b if b in _TERM_BYTES else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
_SLICE = 1 << 20
_CELLS = 1 << 20


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Queries:
    """Items of one block: their terms, and for each term the items that hold it and how often."""

    def __init__(self, items: list[tuple[object, bytes]]) -> None:
        self.names = [name for name, _ in items]
        number: dict[bytes, int] = {}
        cells = [(number.setdefault(term, len(number)), q, n) for q, (_, text) in enumerate(items) for term, n in Counter(terms_of(text)).items()]
        self.terms = list(number)
        term, self.item, self.times = np.array(sorted(cells), np.int64).reshape(-1, 3).T
        self.start = np.searchsorted(term, np.arange(len(number) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            made.add_word(f" {term.decode('latin-1')} ", k)
        made.make_automaton()
        return made


class Scanner:
    """Term counts of the texts of a slice."""

    def __init__(self, queries: Queries) -> None:
        self.queries = queries
        self.automaton = queries.automaton()

    @staticmethod
    def _pieces(folded: str) -> Iterator[tuple[int, str]]:
        """Stretches that share the guard between them, with their positions."""
        at = 0
        while at < len(folded) - 1:
            stop = folded.find(" ", at + _SLICE)
            stop = len(folded) - 1 if stop < 0 else stop
            yield at, folded[at: stop + 1]
            at = stop

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text; and (text, term, frequency) of the items' terms, in order."""
        folded = b" ".join([b"", *[t.translate(_FOLD) for t in texts], b""])
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        inside = np.frombuffer(folded, np.uint8) != 0x20
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        n = np.diff(np.searchsorted(begins, starts))
        keys = []
        for offset, piece in self._pieces(folded.decode("latin-1")):
            hits = self.automaton.iter(piece)
            while chunk := list(islice(hits, 1 << 16)):
                end, term = np.array(chunk, np.int64).T
                # a hit ends with the guard after the term, which the next text's range begins with
                keys.append((np.searchsorted(starts, end + offset - 1, "right") - 1) * len(self.queries.terms) + term)
        found, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        text, term = np.divmod(found, max(len(self.queries.terms), 1))
        return n, text, term, tf


@lru_cache(1)
def _scanner(shared: Broadcast) -> Scanner:
    return Scanner(shared.value)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items with a text, a bounded block at a time."""
    picked = items.select(F.col(f"`{id_col}`").alias("item"), F.encode(F.col(f"`{text_col}`"), "utf-8").alias("text")).where("text is not null")
    block, size = [], 0
    for row in picked.toLocalIterator():
        if block and (size + len(row.text) > block_bytes or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row.item, bytes(row.text)))
        size += len(row.text)
    if block:
        yield block


def _statistics(texts: DataFrame, shared: Broadcast) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each of the items' terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        width = len(scanner.queries.terms)
        df, totals = np.zeros(width, np.int64), np.zeros(2, np.int64)
        for part in text_slices(batches, "text", _SLICE):
            n, _, term, _ = scanner.count(raw_texts(part.column("text")))
            df += np.bincount(term, minlength=width)
            totals += (n > 0).sum(), n.sum()
        names = np.r_[np.flatnonzero(df), -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.r_[df[df > 0], totals], pa.int64())], names=["term", "n"])

    # as many rows as the block has terms, and two
    rows = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(shared.value.terms))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class BestDocuments:
    """The best documents of every item so far; what cannot reach an item's list any more is dropped."""

    def __init__(self, n_items: int, best: int, kind: pa.DataType) -> None:
        self.best, self.floor = best, np.ones(n_items, np.int64)
        self.table = pa.table({"q": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "doc": pa.array([], kind)})

    def add(self, scores: np.ndarray, docs: pa.Array) -> None:
        """Rows of ``scores`` are documents, columns are items."""
        if len(scores) > self.best:
            self.floor = np.maximum(self.floor, np.partition(scores, len(scores) - self.best, axis=0)[len(scores) - self.best])
        row, q = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        new = pa.table({"q": pa.array(q, pa.int32()), "score": pa.array(scores[row, q], pa.int64()), "doc": docs.take(pa.array(row))})
        both = pa.concat_tables([self.table, new])
        both = both.take(pc.sort_indices(both, [("q", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_end"))
        q = both["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.table = both.filter(pa.array(place < self.best)).combine_chunks()
        q, score = self.table["q"].to_numpy(), self.table["score"].to_numpy()
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.best - 1)
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])


def _scores(found: tuple[np.ndarray, ...], queries: Queries, weight: np.ndarray, n_docs: int, n_terms: int, lo: int, hi: int) -> np.ndarray:
    """Scores of texts ``lo`` to ``hi`` under every item."""
    n, text, term, tf = found
    a, b = np.searchsorted(text, (lo, hi))
    text, term, tf = text[a:b], term[a:b], tf[a:b]
    length = 100 - 75 + (75 * n[text] * n_docs) // max(n_terms, 1)
    share = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length))
    count = queries.start[term + 1] - queries.start[term]
    cell = np.arange(count.sum()) + np.repeat(queries.start[term] - np.r_[0, np.cumsum(count)[:-1]], count)
    out = np.zeros((hi - lo, len(queries.names)), np.int64)
    np.add.at(out.reshape(-1), np.repeat((text - lo) * len(queries.names), count) + queries.item[cell], np.repeat(share, count) * queries.times[cell])
    return out


def _task_lists(docs: DataFrame, shared: Broadcast, weight: np.ndarray, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """Every task's best documents of every item."""
    kind = docs.schema["doc"].dataType
    shape = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("doc", kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, scanner = None, _scanner(shared)
        queries = scanner.queries
        step = max(64, _CELLS // len(queries.names))
        for part in text_slices(batches, "text", _SLICE):
            lists = lists or BestDocuments(len(queries.names), best, part.column("doc").type)
            found = scanner.count(raw_texts(part.column("text")))
            for lo in range(0, part.num_rows, step):
                hi = min(lo + step, part.num_rows)
                lists.add(_scores(found, queries, weight, n_docs, n_terms, lo, hi), part.column("doc").slice(lo, hi - lo))
        if lists:
            yield from lists.table.to_batches()

    return docs.mapInArrow(run, shape)


def _first(lists: DataFrame, best: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id",
           text_col: str = "text", best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: up to ``best`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    picked = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kind = items.schema[item_id].dataType
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        queries = Queries(block)
        if not queries.terms:
            continue
        shared = spark.sparkContext.broadcast(queries)
        n_docs, n_terms, df = _statistics(picked, shared)
        lists = _task_lists(picked, shared, weights(n_docs, df), n_docs, n_terms, best)
        lists = _first(lists.withColumn("part", F.spark_partition_id() % SPREAD), best, "q", "part")
        ranked = _first(lists.select("q", "score", "doc"), best, "q")
        names = spark.createDataFrame(list(enumerate(queries.names)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", kind)]))
        found = ranked.join(F.broadcast(names), "q").select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    nothing = T.StructType([T.StructField(item_id, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, picked.schema["doc"].dataType),
                            T.StructField("score", T.LongType())])
    return spark.createDataFrame([], nothing)
