"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mark(edges: DataFrame) -> tuple[int, int]:
    """(rows, order-free digest) of an edge table: equal marks end the loop."""
    r = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return r[0], r[1] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; ``component`` is the
    smallest node reachable.

    Each round connects every node's larger neighbours to its smallest one and
    then its smaller neighbours to the smallest; the rows never exceed the
    edges, and rounds grow with the logarithm of the longest path.  Hub nodes
    are aggregated map-side and joined (no group is collected); every round is
    written to the shared folder.  Self-loops, null ends and repeated edges
    are allowed: a null end is ignored, a self-loop alone makes a component of
    one.  An empty table gives no rows.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = ends.where("u = v").select(F.col("u").alias("node")).distinct()
    now = staged(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # large star: u's larger neighbours point to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = staged(big, "large-star")
        # small star: u and its smaller neighbours point to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = staged(small, "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    both = found.unionByName(roots)
    alone = loops.join(both, "node", "left_anti").select("node", F.col("node").alias("component"))
    return both.unionByName(alone)
