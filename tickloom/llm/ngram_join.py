"""Similarity join of documents by the Jaccard measure of their word shingles.

Documents with equal shingle sets are one class, found by a 128-bit digest of the set, and only
one member of a class goes on.  A forest of MinHash tries proposes candidates: each tree
labels a class with a sequence of minima, and the classes below a node of the trie share a prefix of their labels.
Classes meet at the full label first.  The prefix is shortened, one minimum at a time, for the classes that have
found no partner yet, until a pair at the threshold is met with the target recall (``recall_at``).

Who meets is not yet linked: all minima of both labels estimate their similarity, and only estimates
within four standard errors of the threshold go on, so pages that share a template do not chain.  In a node every class is
compared with the smallest one; nodes in which that fails for some are compared pair by pair, in blocks.
The components of these links are the candidate groups; each class ships its text to its group once.  Groups larger than a block
are cut into blocks, and every pair of blocks is verified by exact set intersection, so a
large group is many tasks and no pair is emitted: a block pair returns, per document,
the number of links and one spanning link.

Defined results: words are runs of letters and digits, case ignored; fewer than five words form one
shingle.  Null, empty and wordless texts link with nothing.  Equal texts always
link.  Repeated rows and rows with null ids are documents of their own; ``class_id`` is the
smallest non-null id of the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.arrowtools import text_slices
from tickloom.llm.components import components
from tickloom.llm.shingles import mix, shingles
from tickloom.session import materialise

THRESHOLD = 0.8
TREES, LABEL = 32, 8
RECALL = 0.999
#: Classes verified against each other in one task, and labels compared with each other.
BLOCK, LABEL_BLOCK = 256, 1024
_SLICE = 1 << 20


def recall_at(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Probability that a pair at the threshold shares a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - threshold ** depth) ** trees


def depths(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> list[int]:
    """The full label, then shorter and shorter prefixes until the target recall is met."""
    out = [label]
    while out[-1] > 1 and recall_at(out[-1], threshold, trees) < recall:
        out.append(out[-1] - 1)
    return out


def least_estimate(threshold: float, n: int) -> float:
    """Share of ``n`` equal minima that a pair at the threshold falls below once in 30,000 times."""
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / n)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, row: str, text: str, trees: int = TREES, label: int = LABEL) -> DataFrame:
    """``row``, the distinct shingles' number and digest, and the labels of all trees as 16-bit minima."""
    shift, factor = _seeds(trees * label)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, _SLICE):
            h, bounds = shingles(part.column(text).to_pylist())
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            minima = np.zeros((part.num_rows, trees * label), np.uint16)
            for k in range(trees * label if len(some) else 0):
                m = np.minimum.reduceat((h ^ shift[k]) * factor[k], bounds[some])
                minima[some, k] = (mix(m) >> np.uint64(48)).astype(np.uint16)
            size, a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            for i in some:
                own = np.unique(h[bounds[i]: bounds[i + 1]])
                size[i] = len(own)
                a[i] = np.add.reduce(own)
                b[i] = np.add.reduce(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            yield pa.RecordBatch.from_arrays(
                [part.column(row), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.array([m.tobytes() for m in minima], pa.binary())], names=[row, "size", "a", "b", "labels"])

    return docs.select(row, text).mapInArrow(sign, f"{row} long, size long, a long, b long, labels binary")


def _nodes(classes: DataFrame, trees: int, label: int, depth: int) -> DataFrame:
    """``(rep, node)``: the node of every tree that a class lies below at a depth."""
    step = 2 * label
    prefix = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                         lambda t: F.struct(t.alias("tree"), F.substring("labels", t * step + 1, F.lit(2 * depth)).alias("prefix")))
    return classes.select("rep", F.explode(prefix).alias("p")).select("rep", F.xxhash64("p.tree", "p.prefix").alias("node"))


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _close_pairs(pairs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The pairs ``(rep, head)`` whose labels agree in a large enough share."""
    both = pairs.join(labels.select("rep", F.col("labels").alias("a")), "rep").join(
        labels.select(F.col("rep").alias("head"), F.col("labels").alias("b")), "head")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_minima(batch.column("a")) == _minima(batch.column("b"))).mean(axis=1) >= least
                yield batch.select(["rep", "head"]).filter(pa.array(equal))

    return both.select("rep", "head", "a", "b").mapInArrow(compare, "rep long, head long")


def _links_in_nodes(members: DataFrame, labels: DataFrame, least: float, block: int) -> DataFrame:
    """Spanning links among the classes of each node whose labels agree, pair by pair of blocks."""
    sizes = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    rows = members.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(labels, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rep", "labels")

    def compare(table: pa.Table) -> pa.Table:
        names, minima = table.column("rep").to_numpy(), _minima(table.column("labels"))
        equal = np.zeros((len(names), len(names)), np.uint16)
        for k in range(minima.shape[1]):
            equal += minima[:, k, None] == minima[None, :, k]
        root = _labels(equal >= least * minima.shape[1], names)
        linked = names != root
        return pa.table({"rep": names[linked], "head": root[linked]})

    return rows.groupBy("node", "i", "j").applyInArrow(compare, "rep long, head long")


def _candidate_groups(classes: DataFrame, threshold: float, trees: int, label: int, recall: float, block: int = LABEL_BLOCK) -> DataFrame:
    """``(vertex, component)``: classes that are connected by estimated links."""
    least, found = least_estimate(threshold, trees * label), None
    steps = depths(threshold, trees, label, recall)
    # who is alone below the shortest prefixes of all trees meets nobody: only the others' labels are looked at again
    shortest = _nodes(classes, trees, label, steps[-1])
    shared = shortest.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = materialise(classes.join(shortest.join(shared, "node", "left_semi").select("rep").distinct(), "rep", "left_semi"))
    for depth in steps:
        keys = _nodes(classes, trees, label, depth)
        if found is None:
            heads = keys.groupBy("node").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        else:  # nodes with a class that has no partner yet
            partnered = found.select("rep").union(found.select("head")).distinct().withColumn("partnered", F.lit(True))
            keys = keys.join(partnered, "rep", "left")
            heads = keys.groupBy("node").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n"), F.count("partnered").alias("old")).where("n > 1 and old < n")
        star = materialise(keys.join(heads.select("node", "head"), "node").where("rep <> head").select("rep", "head", "node"))
        close = materialise(_close_pairs(star.select("rep", "head").distinct(), classes, least))
        apart = star.join(close, ["rep", "head"], "left_anti").select("node", "head").distinct()
        members = star.select("node", "rep").unionByName(star.select("node", F.col("head").alias("rep")).distinct())
        members = materialise(members.join(apart.select("node"), "node", "left_semi"))
        links = close.unionByName(materialise(_links_in_nodes(members, classes, least, block)))
        found = links if found is None else found.unionByName(links)
    return components(found, "rep", "head")


def _intersections(sets: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of distinct hashes."""
    out = np.zeros((len(sets), len(other)))
    every = np.concatenate([*sets, *other])
    _, code, seen = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(seen > 1) - 1  # shingles of a single set cannot be shared
    owner = np.repeat(np.arange(len(sets) + len(other)), [len(s) for s in (*sets, *other)])
    shared = seen[code] > 1
    owner, column = owner[shared], number[code[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        matrix = np.zeros((len(sets) + len(other), width), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - start] = 1
        out += matrix[: len(sets)] @ matrix[len(sets):].T
    return out


def _labels(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name reachable by links, for a symmetric boolean matrix."""
    now = names.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(now, np.where(linked, now[None, :], big).min(axis=1))
        if (new == now).all():
            return now
        now = new


def _verify_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity inside each (group, i, j): per class its links and a spanning link."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, copies, side, sets, square = [], [], [], [], True
        for batch in batches:
            square = batch.column("i")[0].as_py() == batch.column("j")[0].as_py()
            name += batch.column("rep").to_pylist()
            copies += batch.column("copies").to_pylist()
            side += [x == y for x, y in zip(batch.column("block").to_pylist(), batch.column("i").to_pylist())]
            for part in text_slices([batch], "text", _SLICE):
                h, bounds = shingles(part.column("text").to_pylist())
                sets += [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        name, copies, side = np.asarray(name, np.int64), np.asarray(copies, np.int64), np.asarray(side)
        left, right = (np.arange(len(name)),) * 2 if square else (np.flatnonzero(side), np.flatnonzero(~side))
        if not len(left) or not len(right):
            return
        common = _intersections([sets[k] for k in left], [sets[k] for k in right])
        size = np.array([len(s) for s in sets], float)
        with np.errstate(invalid="ignore", divide="ignore"):
            near = common / (size[left][:, None] + size[right][None, :] - common) >= threshold
        linked = np.zeros((len(name), len(name)), bool)
        linked[np.ix_(left, right)] = near
        linked |= linked.T
        np.fill_diagonal(linked, False)
        links = linked @ copies
        keep = np.flatnonzero(links)
        if len(keep):
            root = _labels(linked, name)
            yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(links[keep]), pa.array(root[keep])], names=["rep", "links", "root"])

    return rows.groupBy("component", "i", "j").applyInArrow(verify, "rep long, links long, root long")


def similarity_groups(stored: DataFrame, row: str, text: str, threshold: float = THRESHOLD, trees: int = TREES,
                      label: int = LABEL, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(row, root, n_links)`` for each row of a stored table with unique row numbers.

    ``root`` is the smallest row reachable by links of at least ``threshold``; ``n_links`` counts other rows linked directly.
    """
    signed = materialise(signatures(stored, row, text, trees, label))
    classes = materialise(signed.where("size > 0").groupBy("a", "b", "size").agg(
        F.min(row).alias("rep"), F.count(F.lit(1)).alias("copies")))
    labelled = materialise(signed.join(classes.select(F.col("rep").alias(row)), row).select(F.col(row).alias("rep"), "labels"))
    groups = materialise(_candidate_groups(labelled, threshold, trees, label, recall))
    blocks = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    members = groups.withColumnRenamed("vertex", "rep").join(blocks, "component").join(classes.select("rep", "copies"), "rep")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = stored.select(F.col(row).alias("rep"), F.col(text).alias("text"))
    pairs = members.join(texts, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
                         "block", "rep", "copies", "text")
    found = materialise(_verify_blocks(pairs, threshold))
    roots = components(found, "rep", "root").select(F.col("vertex").alias("rep"), F.col("component").alias("root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = classes.select("a", "b", "size", "rep", "copies").join(links, "rep", "left").join(roots, "rep", "left")
    merged = merged.where("copies > 1 or links is not null").select(
        "a", "b", "size", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    return signed.select(row, "a", "b", "size").join(merged, ["a", "b", "size"], "left").select(
        row, F.coalesce("root", row).alias("root"), F.coalesce("n", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``id_col``, ``class_id``, ``n_links`` and ``kept`` (one document of each class)."""
    base = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    groups = materialise(similarity_groups(base, "row", "text", **options))
    named = base.select("row", "id").join(groups, "row")
    ids = materialise(named.groupBy("root").agg(F.min("id").alias("class_id")))  # stored, so that the join back is a plain one that AQE can split
    return named.join(ids, "root").select(F.col("id").alias(id_col), "class_id", "n_links", (F.col("row") == F.col("root")).alias("kept"))


def keep_one(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one (the first stored) of each class; columns are as given, whatever their names."""
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = materialise(docs.select(F.monotonically_increasing_id().alias("row"), given.alias("given")))
    texts = base.select("row", F.col(f"given.`{text_col}`").alias("text"))
    groups = similarity_groups(texts, "row", "text", **options)
    gone = materialise(groups.where(F.col("row") != F.col("root")).select("row"))
    return base.join(gone, "row", "left_anti").select(*[F.col(f"given.`{c}`").alias(c) for c in docs.columns])
