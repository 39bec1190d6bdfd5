"""Connected components of an edge table, by alternating star contractions.

Every round rewires edges to smaller neighbours: first the larger neighbours of a vertex to
its smallest one, then the smaller ones.  Components turn into stars around their smallest
vertex in about log(n) rounds.  Hubs are aggregated with map-side combination (a minimum per
vertex) and joined back, so no vertex's neighbours are ever gathered in one row.  The minima are
stored before they are joined: then the join is a plain one, of which AQE splits the hubs.
Each round is stored, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from the larger to the smaller vertex
    lowest = materialise(edges.groupBy("u").agg(F.min("v").alias("m")))
    rest = edges.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(lowest.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(vertex, component)`` for every vertex that has an edge; ``component`` is the smallest vertex reachable.

    Vertices are long values; loops and repeated edges are fine.  Without edges the result is empty.
    """
    pair = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col("u") != F.col("v"))
    now = materialise(pair.distinct())
    mark = None
    while True:
        step = materialise(_small_star(materialise(_large_star(now).distinct())).distinct())
        new = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = step
        if tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
    roots = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return roots.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
