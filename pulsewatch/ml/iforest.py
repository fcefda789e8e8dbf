"""Isolation forest on Spark.

MLlib has no isolation forest, so it is built from DataFrame steps:

1. sampling: each row joins tree ``t`` when a hash of (t, row key) falls under
   a rate that yields about twice the sub-sample size per tree; within each
   tree the ``max_samples`` smallest hashes are kept (a per-tree top-k, planned
   as a window group limit).  The sample depends only on the keys, never on
   partitioning, so repeated runs give the same forest.
2. fitting: ``groupBy(tree).applyInPandas`` grows every tree on an executor
   from its <= 256-row sample (numpy, random splits seeded by tree id).
3. scoring: the forest is a node table of at most trees x (2 x 256 - 1)
   rows -- bounded by the parameters, not the data -- broadcast to a
   vectorised ``pandas_udf`` that walks all trees for a batch of rows.

Score = 2 ** (-E[h(x)] / c(n)), the usual isolation score (higher = more
anomalous); ``score_samples`` (higher = normal) is its negation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(tree_id: int, x: np.ndarray, max_depth: int) -> list[tuple]:
    """One isolation tree as node rows (iterative, no recursion)."""
    rng = np.random.default_rng(1_000_003 + tree_id)
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]      # rows, depth, parent, side
    while stack:
        rows, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([tree_id, nid, -1, 0.0, -1, -1, int(len(rows))])
        if parent >= 0:
            nodes[parent][4 if side == 0 else 5] = nid
        if depth >= max_depth or len(rows) <= 1:
            continue
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        nodes[nid][2], nodes[nid][3] = f, thr
        left = rows[sub[:, f] < thr]
        right = rows[sub[:, f] >= thr]
        stack.append((right, depth + 1, nid, 1))
        stack.append((left, depth + 1, nid, 0))
    return [tuple(n) for n in nodes]


def fit(df: DataFrame, feature_cols: list[str], key_cols: list[str], n_trees: int = 200,
        max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Grow the forest; returns the node table (bounded size)."""
    ship_code(df.sparkSession)
    n = df.count()
    psi = int(min(max_samples, n))
    rate = min(1.0, 2.0 * psi / max(n, 1))
    cut = int(rate * (2 ** 31 - 1))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    h = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("_k")), F.lit(2 ** 31 - 1))
    picked = df.select(*[F.col(c).cast("double").alias(c) for c in feature_cols], key.alias("_k")) \
        .select("*", F.explode(F.filter(trees, lambda t: h(t) < cut)).alias("tree"))
    picked = picked.withColumn("_h", F.xxhash64(F.lit(seed), F.col("tree"), F.col("_k")))
    w = Window.partitionBy("tree").orderBy("_h", "_k")
    sample = picked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    cols = list(feature_cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["_h", "_k"])[cols].to_numpy(dtype=float)
        return pd.DataFrame(_grow(t, x, max_depth),
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    return sample.select("tree", "_h", "_k", *cols).groupBy("tree").applyInPandas(grow, NODE_SCHEMA) \
        .withColumn("psi", F.lit(psi))


def _arrays(forest: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, path length added at the node) per tree."""
    if not len(forest):
        return []
    return [(t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(),
             np.array([c_factor(s) for s in t["size"]]))
            for _, t in forest.sort_values(["tree", "node"]).groupby("tree", sort=True)]


def _walk(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row of x over all trees (vectorised per tree)."""
    total = np.zeros(len(x))
    for feat, thr, left, right, ends in trees:
        node = np.zeros(len(x), dtype=int)
        depth = np.zeros(len(x))
        active = feat[node] >= 0
        while active.any():
            idx = np.flatnonzero(active)
            f = feat[node[idx]]
            go_left = x[idx, f] < thr[node[idx]]
            node[idx] = np.where(go_left, left[node[idx]], right[node[idx]])
            depth[idx] += 1
            active = feat[node] >= 0
        total += depth + ends[node]
    return total / max(len(trees), 1)


def score(df: DataFrame, forest: DataFrame, feature_cols: list[str], out: str = "iso_score") -> DataFrame:
    """Add the isolation score (0..1, higher = more anomalous)."""
    spark = df.sparkSession
    ship_code(spark)
    rows = forest.collect()            # bounded: trees x (2 psi - 1) node rows
    psi = rows[0]["psi"] if rows else 256
    bc = spark.sparkContext.broadcast(_arrays(pd.DataFrame([r.asDict() for r in rows])))  # arrays built once, here
    cn = c_factor(psi)

    @F.pandas_udf(T.DoubleType())
    def iso(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(np.power(2.0, -_walk(bc.value, x) / cn))

    return df.withColumn(out, iso(*[F.col(c).cast("double") for c in feature_cols]))


def quantiles(df: DataFrame, col: str, shares: list[float], buckets: int = 256) -> DataFrame:
    """Exact quantiles (linear between ranks) ``q0``, ``q1``, ... in one row,
    without bringing the values to one task.

    Distinct values with their counts are cut into buckets at approximate
    quantiles; a bucket's offset comes from a ``buckets``-row table and ranks
    inside it from a running sum, so no window spans the whole column.
    """
    s = F.col(col).cast("double")
    d = df.select(s.alias("s")).where("s IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    cuts = d.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10000).alias("cuts"))
    d = d.crossJoin(F.broadcast(cuts))  # one-row side holding bucket edges
    d = d.withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    per = d.groupBy("b").agg(F.sum("n").alias("bn"))
    whole = Window.partitionBy()
    per = per.select("b", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
                     F.sum("bn").over(whole).alias("total"))  # <= buckets rows
    d = d.join(per, "b").withColumn("upto", F.col("off") + F.sum("n").over(
        Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("s")))

    out = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return d.agg(*out)


def cutoffs(scored: DataFrame, contaminations: list[float], col: str = "iso_score") -> DataFrame:
    """One row ``c0``, ``c1``, ...: the score at each (1 - contamination)
    quantile; rows strictly above it are anomalies."""
    got = quantiles(scored, col, [1.0 - c for c in contaminations])
    return got.select(*[F.col(f"q{i}").alias(f"c{i}") for i in range(len(contaminations))])
