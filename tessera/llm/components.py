"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round groups edges by a node for its least neighbour (summed up on the
map side) and joins that back, so no node's neighbours are ever collected; a
node with a large share of the edges is dealt to several tasks.
Rounds are written as tables in the shared folder; the number of rounds grows
with the logarithm of the graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import delete, join_dealt, materialise


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.unionAll(down).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n_rows")).withColumn("m", F.least("u", "m"))
    joined = join_dealt(down, least.drop("n_rows"), ["u"], least.select("u", "n_rows"), total)
    return joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
    own = least.select("u", F.col("m").alias("v"))
    joined = join_dealt(edges, least.drop("n_rows"), ["u"], least.select("u", "n_rows"), total)
    rest = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionAll(rest).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or only edges from above: then nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per_node = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per_node.filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) for the nodes of ``edges`` (a, b), and the table's path.

    A component's number is its least node.  Nodes without edges are not in
    the result.  Loops and repeated edges do no harm.
    """
    start = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialise(start, "edges")
    while not _are_stars(now):
        total = now.count()
        following, new_path = materialise(_small_star(_large_star(now, total), total), "edges")
        delete(now.sparkSession, path)
        now, path = following, new_path
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")), path


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a bipartite link matrix, as (row, column) pairs."""
    n, m = linked.shape
    rows_left, cols_left = linked.any(axis=1), linked.any(axis=0)
    across = np.ascontiguousarray(linked.T)
    out = []
    for root in np.flatnonzero(rows_left):
        if not rows_left[root]:
            continue
        rows_left[root] = False
        stack = [(True, root)]
        while stack:
            is_row, i = stack.pop()
            if is_row:
                new = np.flatnonzero(linked[i] & cols_left)
                cols_left[new] = False
                out += [(i, j) for j in new]
            else:
                new = np.flatnonzero(across[i] & rows_left)
                rows_left[new] = False
                out += [(j, i) for j in new]
            stack += [(not is_row, j) for j in new]
    return out
