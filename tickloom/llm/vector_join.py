"""Near-duplicate vectors by an inverted multi-index: a product grid of two codebooks.

Unit vectors are halved, each half has its own codebook, and the pair of nearest codewords is
the cell of a vector.  To find its neighbours a vector visits cells in the order of the sum of
both half distances (multi-sequence traversal).  How many cells are visited is set on a
bounded sample: the smallest number with which known pairs reach the target recall.  Where ``MAX_VISITS``
cells do not reach it, the codebooks are halved until they do; a grid of at most that many cells is visited whole.  Found pairs are
verified by their cosine in double precision.

Equal vectors are one class before anything is joined, so a vector that a third of all rows
share costs as much as one.  A cell's members and visitors meet in blocks; a block pair emits
per vector the number of links and one spanning link, never the pairs.

Defined results: null and empty vectors, zero vectors and those with null, NaN or infinite components link with
nothing, and neither do vectors of different lengths.  Repeated rows and rows with null ids are vectors of their own;
``component_id`` is the smallest non-null id reachable.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.components import components
from tickloom.session import materialise

COSINE = 0.9
RECALL = 0.98
#: Bound of the sample on which codebooks are fitted and the number of visits is set.
SAMPLE = 8192
#: Vectors wanted in a cell, and the largest codebook of a half.
PER_CELL, MAX_CODES = 32, 1024
MAX_VISITS = 256
BLOCK = 1024


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(11)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        n = np.bincount(nearest, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def traverse(left: np.ndarray, right: np.ndarray, visits: int) -> np.ndarray:
    """The ``visits`` cells with the smallest sum of half distances, nearest first, per row.

    The n-th cell of the sequence has ranks (i, j) with (i + 1) * (j + 1) <= n, so only those
    pairs of the two sorted distance lists compete.
    """
    a, b = np.argsort(left, axis=1, kind="stable"), np.argsort(right, axis=1, kind="stable")
    da, db = np.take_along_axis(left, a, 1), np.take_along_axis(right, b, 1)
    ranks = np.array([(i, j) for i in range(min(visits, left.shape[1])) for j in range(min(visits // (i + 1), right.shape[1]))])
    total = da[:, ranks[:, 0]] + db[:, ranks[:, 1]]
    order = np.argsort(total, axis=1, kind="stable")[:, :visits]
    i, j = ranks[order, 0], ranks[order, 1]
    return np.take_along_axis(a, i, 1) * right.shape[1] + np.take_along_axis(b, j, 1)


class MultiIndex:
    """Two codebooks and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float, recall: float) -> None:
        half = sample.shape[1] // 2
        codes = int(min(MAX_CODES, max(2, np.ceil(np.sqrt(total / PER_CELL))), max(2, len(sample) // 8)))
        self.half = half
        while True:
            self.left, self.right = _kmeans(sample[:, :half], codes), _kmeans(sample[:, half:], codes)
            self.visits = self._calibrate(sample, cosine, recall)
            if self.visits <= min(MAX_VISITS, len(self.left) * len(self.right)):
                break
            codes //= 2  # larger cells, still compared whole

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        out = [traverse(_distances(x[k: k + 512, : self.half], self.left), _distances(x[k: k + 512, self.half:], self.right), visits)
               for k in range(0, len(x), 512)]
        return np.concatenate(out)

    def _calibrate(self, sample: np.ndarray, cosine: float, recall: float) -> int:
        """Visits until the target recall over the sample's own pairs and pairs placed just at the limit; one more than allowed if they miss it."""
        grid = len(self.left) * len(self.right)
        most = min(MAX_VISITS, grid)
        rng = np.random.default_rng(13)
        base = sample[rng.choice(len(sample), min(1024, len(sample)), replace=False)]
        noise = rng.normal(size=base.shape)
        noise -= (noise * base).sum(1)[:, None] * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        angle = np.arccos(min(1.0, cosine + 0.01))
        other = np.cos(angle) * base + np.sin(angle) * noise
        for k in range(0, min(len(sample), 4096), 512):
            near = np.argwhere(sample[k: k + 512] @ sample[:4096].T >= cosine)
            near = near[near[:, 0] + k != near[:, 1]][:256]
            base, other = np.r_[base, sample[near[:, 0] + k]], np.r_[other, sample[near[:, 1]]]
        ways, home = self.cells(base, most), self.cells(other, 1)[:, 0]
        back, start = self.cells(other, most), self.cells(base, 1)[:, 0]
        far = most + 1
        one = np.where((ways == home[:, None]).any(1), (ways == home[:, None]).argmax(1) + 1, far)
        two = np.where((back == start[:, None]).any(1), (back == start[:, None]).argmax(1) + 1, far)
        need = np.sort(np.minimum(one, two))
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])


def unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _classes(vectors: DataFrame, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and one row per distinct usable vector with its number of copies."""
    x = F.col(vec_col).cast("array<double>")
    usable = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    # adding 0 turns -0.0 into 0.0, so equal vectors have equal keys
    clean = F.when(F.coalesce(usable, F.lit(False)), F.transform(x, lambda v: v + F.lit(0.0)))
    rows = materialise(vectors.withColumn("__x", clean).select(
        F.monotonically_increasing_id().alias("row"), F.col("__id").alias("id"), F.col("__x").alias("x"),
        F.xxhash64("__x").alias("a"), F.hash("__x").alias("b"), F.size("__x").alias("n")))
    classes = rows.where(F.col("x").isNotNull()).groupBy("n", "a", "b").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return rows, materialise(classes)


def _blocks(members: DataFrame, keys: list[str]) -> DataFrame:
    """Give each row a block number below the number of blocks of its cell."""
    sizes = members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    return members.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def _spread_labels(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest name reachable inside a block pair, for both sides."""
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        new_a = np.minimum(a, np.where(near, b[None, :], big).min(axis=1, initial=big))
        new_b = np.minimum(b, np.where(near, new_a[:, None], big).min(axis=0, initial=big))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                 recall: float = RECALL) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__v"))
    rows, classes = _classes(picked, "__v")
    totals = {r.n: r.total for r in classes.groupBy("n").agg(F.count(F.lit(1)).alias("total")).collect()}
    reps = classes.select("rep", "copies").join(rows.select(F.col("row").alias("rep"), "x", "n"), "rep")
    found = None
    for width, total in sorted(totals.items()):  # vectors of one length are a space of their own
        part = _links(spark, reps.where(F.col("n") == width), total, cosine, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, root long")
    found = materialise(found)
    roots = components(found, "rep", "root").select(F.col("vertex").alias("rep"), F.col("component").alias("root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = classes.join(links, "rep", "left").join(roots, "rep", "left").where("copies > 1 or links is not null").select(
        "n", "a", "b", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.where(F.col("x").isNotNull()).select("row", "id", "n", "a", "b").join(merged, ["n", "a", "b"], "left").select(
        "row", "id", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialise(joined.unionByName(rows.where(F.col("x").isNull()).select("row", "id", F.col("row").alias("root"), F.lit(0).cast("long").alias("n_links"))))
    ids = materialise(named.groupBy("root").agg(F.min("id").alias("component_id")))  # stored, so that the join back is a plain one that AQE can split
    return named.join(ids, "root").select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(spark, reps: DataFrame, total: int, cosine: float, recall: float) -> DataFrame:
    """Links and spanning links between distinct vectors of one length."""
    share = int(min(1.0, SAMPLE / total) * (1 << 30))
    sample = reps.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 30)) < share).orderBy("rep").limit(2 * SAMPLE).collect()
    sample = sample or reps.orderBy("rep").limit(1).collect()
    index = MultiIndex(unit([r.x for r in sample]), total, cosine, recall)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column("x").to_pylist())
                ways = shared.value.cells(x, shared.value.visits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("copies"), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array(ways[:, 0].astype(np.int64)), pa.array(list(ways.astype(np.int64)), pa.list_(pa.int64()))],
                    names=["rep", "copies", "x", "home", "ways"])

    placed = materialise(reps.select("rep", "copies", "x").mapInArrow(place, "rep long, copies long, x binary, home long, ways array<long>"))
    members = _blocks(placed.select(F.col("home").alias("cell"), "rep", "copies", "x", "home", "ways"), ["cell"])
    homes = members.select("cell", F.col("blocks").alias("m_blocks")).distinct()
    visitors = placed.select(F.explode("ways").alias("cell"), "rep", "copies", "x", "home", "ways")
    visitors = _blocks(visitors.join(homes, "cell").drop("m_blocks"), ["cell"]).withColumnRenamed("blocks", "v_blocks")
    counts = visitors.select("cell", "v_blocks").distinct()
    m = members.join(counts, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
    m = m.select("cell", F.col("block").alias("mb"), F.col("other").alias("vb"), F.lit(True).alias("member"), "rep", "copies", "x", "home", "ways")
    v = visitors.join(homes, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)))
    v = v.select("cell", F.col("other").alias("mb"), F.col("block").alias("vb"), F.lit(False).alias("member"), "rep", "copies", "x", "home", "ways")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []
        for b in batches:
            cell = b.column("cell")[0].as_py()
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float64).reshape(b.num_rows, -1)
            # does this vector visit a home?  kept as lists, looked up below
            parts.append((b.column("member").to_numpy(zero_copy_only=False), b.column("rep").to_numpy(), b.column("copies").to_numpy(),
                          x, b.column("home").to_numpy(), b.column("ways").to_pylist()))
        side = np.concatenate([p[0] for p in parts]).astype(bool)
        rep, copies, x, home = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
        ways = [w for p in parts for w in p[5]]
        mine, theirs = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(mine) or not len(theirs):
            return
        near = x[mine] @ x[theirs].T >= cosine
        near &= rep[mine][:, None] != rep[theirs][None, :]
        if not near.any():
            return
        # a visitor counts its link here; a member counts it here only if it doesn't meet the visitor at the visitor's home
        back = near.copy()
        for k in np.flatnonzero(near.any(axis=1)):
            at = np.flatnonzero(near[k])
            back[k, at] = ~np.isin(home[theirs[at]], ways[mine[k]])
        to_member, to_visitor = back @ copies[theirs], near.T @ copies[mine]
        a, b = _spread_labels(near, rep[mine], rep[theirs])
        some_a, some_b = near.any(axis=1), near.any(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[rep[mine][some_a], rep[theirs][some_b]]), pa.array(np.r_[to_member[some_a], to_visitor[some_b]]),
             pa.array(np.r_[a[some_a], b[some_b]])], names=["rep", "links", "root"])

    return m.unionByName(v).groupBy("cell", "mb", "vb").applyInArrow(verify, "rep long, links long, root long")
