"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize, remove


def connected_components(edges: DataFrame, low: str, high: str) -> DataFrame:
    """Columns node and root (the least node of the component) of every node that
    has an edge; ``edges`` holds pairs of longs in the columns ``low``, ``high``.

    Loops and repeated pairs do no harm; null ends are left out. Every step is a
    grouped minimum and a join, so a node with many edges is combined before the
    shuffle and split by the adaptive join. Each round is written to the shared
    folder and the one before deleted; the number of rounds grows with the logarithm of the longest chain.
    """
    a, b = F.col(low).cast("long"), F.col(high).cast("long")
    spark = edges.sparkSession
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: larger neighbours move to the least neighbour
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: smaller neighbours and the node itself do the same
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        old = now.inputFiles()
        now = materialize(moved.union(least.select("v", F.col("m").alias("u"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if old:
            remove(spark, old[0].rpartition("/")[0])
        if mark == before:
            break
    roots = now.select("u").distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum: equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each of 0..n-1's component, for edges within one task."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root
